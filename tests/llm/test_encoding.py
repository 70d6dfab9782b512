import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import _bpe, bpe

MARKS = " \n\tabAB'sé.1 \r<|İßŸΣ́日"


def texts(n, seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéñ.,A") for _ in range(rnd.randint(1, 9))) for _ in range(200)]
    return ["".join(rnd.choice(MARKS) for _ in range(rnd.randint(0, 30))) for _ in range(n)] + [
        " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(n)
    ]


def ids(model, text):
    return np.array(model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_coders_are_the_tokenizers(byte_vocabulary, word_vocabulary, monkeypatch):
    given = ["<|endoftext|> a<|endoftext|>", "<|startoftext|>b", *texts(400)]
    for path, kind in ((byte_vocabulary, _bpe.ByteCoder), (word_vocabulary, _bpe.WordCoder)):
        json = _bpe.read(path)
        model, coder = _bpe.tokenizer(json), kind(json)
        want = [ids(model, t) for t in given]
        assert coder.encode(given) == want
        monkeypatch.setattr(_bpe, "KEEP", 50)  # a small table is emptied again and again
        assert [x for i in range(0, len(given), 7) for x in coder.encode(given[i : i + 7])] == want
        if kind is _bpe.WordCoder:
            assert [coder.decode(x) for x in want] == [
                model.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for x in want
            ]


def test_chunks_cover_texts_and_move_with_them():
    rnd = random.Random(2)
    body = "".join(rnd.choice("abc déf\n") for _ in range(30_000)).encode()
    data = np.frombuffer(body + b"zz " + body, np.uint8)
    offsets = np.array([0, len(body), len(data)])
    start, doc, value = bpe.chunks(data, offsets)
    assert start[0] == 0 and start[-1] == len(data) and (np.diff(start) > 0).all() and (
        np.diff(start) <= bpe.MOST
    ).all()
    assert all((data[s] & 0xC0) != 0x80 for s in start[:-1])
    first, second = set(value[doc == 0].tolist()), set(value[doc == 1].tolist())
    assert len(first & second) >= len(first) - 2


def test_encode(docs, spark, word_vocabulary):
    rnd = random.Random(3)
    passage = " ".join(rnd.choice(texts(50, 4)) for _ in range(400))
    solid = "".join(rnd.choice("abcdef日é") for _ in range(40_000))
    more = [(100 + i, f"{t} {passage} {t}") for i, t in enumerate(texts(4, 5))] + [
        (200, solid), (201, "x" + solid), (202, passage), (202, passage), (None, passage)
    ]
    rows = docs.select("doc_id", "text").union(
        spark.createDataFrame(more, "doc_id long, text string")
    ).withColumn("ids_sha256", F.lit("clash")).repartition(4)
    model = _bpe.tokenizer(_bpe.read(word_vocabulary))
    want = Counter()
    for r in rows.collect():
        x = model.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = model.decode(x, skip_special_tokens=False)
        want[
            (
                r["doc_id"],
                len(x),
                hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(),
                hashlib.sha256(decoded.encode()).hexdigest(),
            )
        ] += 1
    got = bpe.encode(rows, word_vocabulary, carry=["doc_id"]).drop("ids")
    assert Counter(map(tuple, got.collect())) == want
    assert bpe.encode(rows.where("false"), word_vocabulary).count() == 0


def test_joins_that_the_tokenizer_doesnt_make_are_found(word_vocabulary):
    """Where the tokenizer takes the text around a join otherwise than from space to space, the document isn't cut."""
    parts = bpe._Parts(_bpe.read(word_vocabulary))
    rnd = random.Random(5)
    documents = [" ".join(rnd.choice(texts(40, 6)) for _ in range(60)).encode() for _ in range(6)] + ["日本é".encode() * 4000]

    def places(data):
        return [x for x in (len(data) // 3, len(data) // 2) if (data[x] & 0xC0) != 0x80]

    joins = [(k, x) for k, d in enumerate(documents) for x in places(d)]
    assert parts.unlike(documents, joins) == set() and len(joins) > 6

    real = parts.coder

    class Merging:
        """Merges "zz yy" into one token, whatever is between, and else does as the vocabulary."""

        encode = staticmethod(real.encode)

        def own(self, found):
            return [b"merged" if "zz yy" in t else x for t, x in zip(found, real.own(found), strict=True)]

    near, far = b"some words zz yy and more words here", b"zz yy " + b"words " * 2000
    parts.coder = Merging()
    assert parts.unlike([near, far, far], [(0, 13), (1, 4), (2, 9000)]) == {0, 1}
