"""The functions the pipeline's stages call, on nulls, repeated rows, clashing columns and empty tables."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from flowtide.llm import decontaminate, line_quality, near_dups, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", ["clean_good", "keep_good", "drop_near_duplicates", "drop_contaminated"])
def test_filters_keep_whole_rows(spark, odd, empty, name):
    items = spark.createDataFrame([(1, "no such words stand in any text here"), (None, None)], "item_id bigint, text string")
    run = {"clean_good": line_quality.clean_good, "keep_good": line_quality.keep_good, "drop_near_duplicates": near_dups.drop_near_duplicates,
           "drop_contaminated": lambda d: decontaminate.drop_contaminated(d, items)}[name]
    got = run(odd)
    assert got.columns == odd.columns and run(empty).count() == 0
    before, after = rows_of(odd), rows_of(got)
    # Rows stay as they are, and equal rows stay or go together.
    assert all(before.count(r) == after.count(r) for r in after)
    blank = odd.where("text IS NULL OR trim(text) = ''").count()
    kept_blank = got.where("text IS NULL OR trim(text) = ''").count()
    assert blank > 0 and kept_blank == (0 if name in ("clean_good", "keep_good") else blank)
    if name == "drop_contaminated":
        assert after == before


def test_packed_pieces_of_odd_rows(odd, empty):
    limits = packing.Limits(tokens=64)
    pieces = packing.pack_documents_ids(odd, PATH, limits)
    got = pieces.collect()
    count = lambda null: sum((r.doc_id is None) == null and r.piece == 0 for r in got)
    assert count(True) == odd.where("doc_id IS NULL").count() and count(False) == odd.where("doc_id IS NOT NULL").count()
    assert all(r.length * 4 == len(r.ids) and 0 < r.length <= 64 for r in got)
    assert rows_of(pieces.drop("ids", "sequence_id", "offset")) == rows_of(
        packing.pack_documents(odd, PATH, limits).drop("sequence_id", "offset"))
    whole = packing.packed_sequences(pieces.withColumn("p", F.lit("clash"))).collect()
    assert sum(len(r.ids) for r in whole) == sum(len(r.ids) for r in got)
    for r in whole:
        parts = sorted((p for p in got if p.sequence_id == r.sequence_id), key=lambda p: p.offset)
        assert bytes(r.ids) == b"".join(bytes(p.ids) for p in parts) and r.doc_starts == [p.offset for p in parts]
    assert packing.pack_documents_ids(empty, PATH, limits).count() == 0
