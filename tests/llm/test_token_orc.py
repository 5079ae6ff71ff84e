"""Token files: ids by the library, offsets and checksums from the files."""

import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc as orc
from tokenizers import Tokenizer

from corpus_fixtures import SF001, make_docs  # noqa: F401
from custlytics.llm import token_orc as O
from custlytics.llm.word_cache import from_bytes

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    tok, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    path = str(tmp_path / "t")
    O.write_tokens(docs, path, partitions=5)
    got = sorted(tuple(r) for r in O.offsets(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected(sorted((r.doc_id, r.text) for r in docs.collect()))


def test_files_hold_ascending_disjoint_ranges_and_answer_lookups(spark, make_docs, tmp_path):
    docs = make_docs([(i, f"text number {i}") for i in range(500)])
    path = str(tmp_path / "t")
    O.write_tokens(docs, path, partitions=4)
    ranges = []
    for f in glob.glob(path + "/*.orc"):
        t = orc.read_table(f)
        ids = t.column("doc_id").to_pylist()
        assert ids == sorted(ids)
        ranges.append((ids[0], ids[-1]))
    ranges.sort()
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    some = O.read_tokens(spark, path, [7, 499, 1000])
    assert sorted(r.doc_id for r in some.collect()) == [7, 499]
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().executedPlan().toString()


def test_edge_rows(spark, make_docs, tmp_path):
    rows = [(None, "x y"), (1, None), (2, ""), (3, "Ünï  CODE\n<|endoftext|> don't"), (3, "Ünï  CODE\n<|endoftext|> don't"), (4, "z " * 30000)]
    path = str(tmp_path / "t")
    O.write_tokens(make_docs(rows, extra={"ids": 1, "part": "clash", "pos": None}), path, partitions=3)
    got = sorted((tuple(r) for r in O.offsets(spark, path).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    O.write_tokens(make_docs([]), path, partitions=3)
    assert O.offsets(spark, path).count() == 0


def test_pieces_equal_whole_texts():
    tok, cached = Tokenizer.from_file(PATH), O.WordTokenizer(PATH)
    for t in ["a ́b éx", "<|endoftext|> a<|endoftext|>b", "A  B\n\nC\t don't ÉÀ İ ẞ 12 34!! 日本 x y　z", "가 ᆨ",
              "ΑΣ ΑΣ.", " ", "'s 's", "\r\n a b"]:
        assert from_bytes(cached.encode([t])[0]).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_hot_ids_are_dealt_over_files(spark, make_docs, tmp_path):
    rows = [(7, f"text {i} of one id") for i in range(600)] + [(None, f"no id {i}") for i in range(400)] + [(i, f"t {i}") for i in range(100)]
    path = str(tmp_path / "t")
    O.write_tokens(make_docs(rows).repartition(3), path, partitions=12)
    stored = O.read_tokens(spark, path).collect()
    sizes = {}
    for r in stored:
        sizes[r.part] = sizes.get(r.part, 0) + 1
    assert len(stored) == len(rows) and max(sizes.values()) < 250
    order = sorted((r.part, r.pos, r.doc_id is not None, r.doc_id or 0) for r in stored)
    assert [x[2:] for x in order] == sorted(x[2:] for x in order)
    got = sorted(tuple(r) for r in O.offsets(spark, path).where("doc_id IS NOT NULL").collect())
    assert sum(n for _, _, n, _ in got) == sum(len(Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids) + 1 for d, t in rows if d is not None)
    assert sorted(d for d, *_ in got) == sorted(d for d, _ in rows if d is not None)
