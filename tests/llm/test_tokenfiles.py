import io
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from lodestar.llm import queries, tokenfiles

from .tables import odd, odd_rows, table

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@cache
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def plain(text, end=2):
    """What the library itself makes of a text."""
    return [*library().encode(text or "", add_special_tokens=False).ids, end]


def brute(rows):
    """Rows of ``(doc_id, text)`` to their digests, in order."""
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain(text)
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def digests(docs):
    return [tuple(r) for r in tokenfiles.digests(tokenfiles.write(docs, PATH)).orderBy("start").collect()]


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = queries.op11_token_files(spark, folder).orderBy("start").collect()
    assert [tuple(r) for r in got] == brute(rows)


def test_texts_are_cut_as_the_library_cuts_them(spark):
    texts = [
        "it's  we'll 'S 12½ ²x a_b\x1cc\x85d\xa0e f", "  two\n\n \tlines \r\n", "日本 🙂 naïve ÀÉß Ɏɏɐ", "<|endoftext|> <|", "", None, " ", "a", "x" * 5000, "\x00\x01 \x7f",
        "don't  stop—now… “q”", "aª º ¼ 3¾", " " * 50 + "end ", "́e ǆ Ǆ ℌ Ⅷ ٣",
    ]
    assert [r[2:] for r in digests(table(spark, texts))] == [r[2:] for r in brute(list(enumerate(texts)))]


@pytest.mark.parametrize("seed", range(3))
def test_random_characters(spark, seed):
    rng = np.random.default_rng(seed)
    pool = [chr(c) for c in [*range(0x250), 0x370, 0x4E00, 0x1F600, 0x300]]
    texts = ["".join(rng.choice(pool, 200)) for _ in range(40)] + ["".join(rng.choice(list(" 'sSt12\n\t.é"), 300)) for _ in range(40)]
    assert [r[2:] for r in digests(table(spark, texts))] == [r[2:] for r in brute(list(enumerate(texts)))]


class Counting:
    """A tokenizer that counts the letters it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.letters = tokenizer, 0

    def encode(self, text, **how):
        self.letters += len(text)
        return self.tokenizer.encode(text, **how)

    def encode_batch_fast(self, texts, **how):
        self.letters += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **how)


def test_pieces_met_before_are_looked_up_whatever_their_letters():
    texts = [f"日本 語{i % 7} and “quoted” words — naïve, 🙂 it's {i % 5}\nnext  line " for i in range(100)]
    e = tokenfiles.Encoder(PATH)
    assert [np.frombuffer(e(x), "<u2").tolist() for x in texts[:40]] == [plain(x)[:-1] for x in texts[:40]]
    e.tokenizer = Counting(e.tokenizer)
    assert [np.frombuffer(e(x), "<u2").tolist() for x in texts] == [plain(x)[:-1] for x in texts]
    assert e.tokenizer.letters < sum(map(len, texts)) / 4


@pytest.mark.parametrize("seed", range(3))
def test_texts_are_cut_at_spaces_as_the_library_cuts_them(seed):
    rng = np.random.default_rng(seed)
    pool = [*"    \n\t\r abE'sSt.,12é\x85\xa0\x1c\u2003\u3000\u200b日🙂\u0301", "<|endoftext|>", " 's", " 'll", "x" * 70]
    texts = ["".join(rng.choice(pool, rng.integers(0, 14))) for _ in range(2000)]
    e = tokenfiles.Encoder(PATH)
    for own in (texts, texts[:500]):
        assert [np.frombuffer(x, "<u2").tolist() for x in tokenfiles._encoded(e, own)] == [plain(x)[:-1] for x in own]


def test_odd_rows(spark):
    want = brute([(r[0], r[1]) for r in odd_rows()])
    assert digests(odd(spark)) == want
    assert digests(odd(spark, [])) == []
    assert tokenfiles.read(tokenfiles.write(odd(spark, []), PATH)).count() == 0


def test_equal_ids_fill_more_than_one_file(spark):
    docs = spark.range(400).select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(7).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 5).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = tokenfiles.write(docs.repartition(8), PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.select("file").distinct().count() > 1
    got = tokenfiles.digests(manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in docs.collect())
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def filled(docs, frame=200):
    out = io.BytesIO()
    w = tokenfiles.Writer(out, 2, frame=frame)
    for i, tokens in docs:
        w.add(i, np.array(tokens, "<u2").tobytes())
    w.close()
    return out.getvalue()


def opened(raw):
    return tokenfiles.Reader(pa.BufferReader(raw))


DOCS = [(None, [5]), *((i, list(range(i % 40 + 1))) for i in range(0, 600, 2)), (601, list(range(3000))), (602, [])]


def test_file_round_trip_and_plain_zstandard():
    raw = filled(DOCS)
    assert [(i, t.tolist()) for i, t in opened(raw).documents()] == DOCS
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert len(whole) == sum(line[2] for line in opened(raw).lines)
    assert list(opened(filled([])).documents()) == []


def test_only_frames_that_may_hold_a_document_are_read():
    r = opened(filled(DOCS))
    frames, whole = [], r.frame
    r.frame = lambda n: (frames.append(n), whole(n))[1]
    assert [(i, t.tolist()) for i, t in r.documents([100, 101, 601])] == [(100, list(range(21))), (601, list(range(3000)))]
    assert len(frames) <= 3 < len(r.lines)
    assert [i for i, _ in r.documents([None])] == [None] and frames[-1] == 0


def test_changed_bytes_are_noticed():
    raw = bytearray(filled(DOCS))
    r = opened(bytes(raw))
    line = r.lines[2]
    raw[line[0] + line[1] // 2] ^= 255
    bad = opened(bytes(raw))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        bad.frame(2)
    assert bad.frame(1) and bad.frame(3)
    with pytest.raises(ValueError):
        opened(bytes(raw[:-1]))


def test_lookup(spark):
    docs = table(spark, [f"document number {i}" for i in range(300)])
    manifest = tokenfiles.write(docs, PATH)
    wanted = spark.createDataFrame([(i,) for i in (3, 4, 250, 999, None, 3)], "doc_id long")
    got = {r.doc_id: r.tokens for r in tokenfiles.lookup(manifest, wanted).collect()}
    assert got == {i: plain(f"document number {i}") for i in (3, 4, 250)}
    assert {r.doc_id: r.tokens for r in tokenfiles.read(manifest).collect()} == {i: plain(f"document number {i}") for i in range(300)}
