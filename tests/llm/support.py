"""Small tables for the tests of this folder."""

import hashlib
import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark, rows, parts: int = 3):
    """(doc_id, text) rows as a documents table, over several partitions."""
    full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(parts)


def given_documents(limit: int | None = None):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return [(r["doc_id"], r["text"]) for r in table][:limit]
