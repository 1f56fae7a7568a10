"""Queries against their SQL over documents that small tables don't have: ids that begin alike, letters without a plain capital, files of uneven sizes."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

from corvane.plans import registry
from tests.compare import agrees

SF = Path("/root/testdata/sf0.001")


def with_documents(tmp_path, rows, **options) -> str:
    """The small tables, with ``rows`` (doc_id, text, lang, source) as documents."""
    for file in SF.glob("*.parquet"):
        if file.name != "documents.parquet":
            (tmp_path / file.name).symlink_to(file)
    names = ("doc_id", "text", "lang", "source", "n_chars")
    columns = zip(*[(*row, len(row[1] or "")) for row in rows], strict=True)
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
    pq.write_table(pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)}), tmp_path / "documents.parquet", **options)
    return str(tmp_path)


def check(spark, name, sf_dir):
    agrees(spark, registry.QUERIES[name], registry.ORACLES[name], sf_dir)


def test_images_of_documents_whose_hashes_begin_alike(spark, tmp_path):
    rows = [(10_324, "a\nb", "en", "src4"), (251_058, "c\n\nd\ne", "en", "src0"), (7, "f", "en", None), (8, None, "en", "src1"), (9, " ", "en", "src1")]
    check(spark, "document_counts", with_documents(tmp_path, rows))


def test_first_letters_without_a_plain_capital(spark, tmp_path):
    lines = [c + "x y" for c in "aßŉǰΐևᾳᾈᾲﬁﬃƛɤéǆⅷ"] + ["", "a \x0b b", "ß", "  ß  z", "ß 7"]
    check(spark, "stage_outcomes", with_documents(tmp_path, [(1, "\n".join(lines), "de", "src1"), (2, "ßa\nb", "de", None), (3, None, "de", "src1")]))


def test_slices_of_uneven_files_through_the_ledger(spark, tmp_path):
    # few documents with low ids, many with high ones, the highest first, and equal texts of several sources
    ids = [*range(0, 300, 60), *range(300, 500, 5), *range(800, 1_000)][::-1]
    rows = [(i, f"text {i % 80} " + "word " * 200, "en", f"src{i % 3}") for i in ids]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        check(spark, "stream_ledger", with_documents(tmp_path, rows, row_group_size=10, compression="none", use_dictionary=False))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
