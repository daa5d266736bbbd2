import hashlib
import random

import pytest
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import bpe_automaton as B
from tessera.llm import char_classes
from tessera.llm.registry import QUERIES
from tessera.session import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
REFERENCE = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return B.Codec(PATH)


def agree(codec, texts):
    for text, (ids, decoded), other in zip(texts, codec.encode_checked(texts), REFERENCE.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == other.ids, text
        assert decoded.decode() == REFERENCE.decode(other.ids, skip_special_tokens=False) == text
        assert codec.digits(ids).decode() == ",".join(map(str, other.ids))


def test_known_cases(codec):
    agree(codec, ["", " ", "   x", "\n\n x\n\ny \n z  ", "don't they'll we've I'm 're'd'sabc ''s !'s 's\n's", "<|endoftext|>a<|endoftext|><|endoftext|>", "a" * 3000, "ab" * 999, "　 a b", "日本語 中文", "\x1c\x1d a\x1fb", "é́ü", "!'''"])


def test_random_texts(codec):
    r = random.Random(1)
    letters = "ab's \n'tlvredm12é!?.,  日ſ"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(4000)]
    texts += ["".join(chr(r.choice([r.randrange(0x20, 0x3000), r.randrange(0x20, 0xD7FF), r.randrange(0xE000, 0x110000)])) for _ in range(r.randint(1, 20))) for _ in range(4000)]
    agree(codec, texts)


def test_classes_are_those_of_the_library():
    table_ = char_classes.table()
    for point in [*range(0x21, 0xD800), *range(0xE000, 0x110000)]:
        found = REFERENCE.pre_tokenizer.pre_tokenize_str("a" + chr(point) + "1")
        kind = char_classes.LETTER if found[0][1][1] == 2 else char_classes.NUMBER if len(found) == 2 else None
        assert (table_[point] == kind) if kind else table_[point] in (char_classes.OTHER, char_classes.WHITE), hex(point)


def test_forgets_and_goes_on():
    small = B.Codec(PATH, words=50)
    r = random.Random(3)
    agree(small, [" ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(n)) for n in (10, 60, 200, 5, 49)])


def test_words_of_one_hash(codec, monkeypatch):
    """Neither words built to collide nor a hash that is hardly one change a token."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    agree(codec, [word + "\n" + word.translate(str.maketrans("ab", "ba")), word.translate(str.maketrans("ab", "ba"))])
    weak = B.Codec(PATH)
    whole = weak._hashes
    monkeypatch.setattr(weak, "_hashes", lambda *x: whole(*x) % 7 + 1)
    r = random.Random(5)
    agree(weak, [" ".join("".join(r.choice("abc'1é") for _ in range(r.randint(1, 3))) for _ in range(n)) for n in (1, 10, 60, 200)] + ["<|endoftext|>abc xyz<|endoftext|>", "abc", "xyz"])
    for text in ("abc xyz", "xyz abc <|endoftext|>"):
        assert weak.encode_checked([text], special=False)[0][1] == text.encode()


def test_automaton_accepts_what_merges_make(codec):
    """A word has one accepted path: no other sequence of its tokens has all arcs."""
    a = codec.automaton

    def paths(word, state=0):
        if not word:
            yield []
        for n in range(1, len(word) + 1):
            token = a.prefixes.get(word[:n], -1)
            if token >= 0 and a.has_arc(state, token):
                for rest in paths(word[n:], a.ends[token]):
                    yield [token, *rest]

    r = random.Random(4)
    for _ in range(300):
        word = bytes(r.choice(b"theran '") for _ in range(r.randint(1, 9)))
        assert list(paths(word)) == [a.encode_word(word)]


def test_column(spark):
    rows = spark.createDataFrame([(1, "Hello world"), (1, "Hello world"), (None, None), (3, "")], "doc_id long, text string")
    got = sorted(B.encode(rows, PATH).collect(), key=lambda r: (r.doc_id or 0, r.decoded))
    assert [(r.doc_id, list(r.ids), r.decoded) for r in got] == [(None, [], ""), (1, REFERENCE.encode("Hello world").ids, "Hello world"), (1, REFERENCE.encode("Hello world").ids, "Hello world"), (3, [], "")]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in table(spark, d, "documents").collect()}
    for r in QUERIES["op7_bpe_automaton"](spark, d).collect():
        ids = REFERENCE.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
