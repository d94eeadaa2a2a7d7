from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SCHEMAS = {
    "documents": pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]),
    "labels": pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]),
    "pages": pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]),
    "benchmark": pa.schema([("item_id", pa.int64()), ("text", pa.string())]),
}


@pytest.fixture
def make(tmp_path):
    """make(documents=[...], pages=[...]): a folder of tables; missing ones are empty. extra adds clashing columns to each."""

    def build(extra: bool = False, **rows) -> str:
        for name, schema in SCHEMAS.items():
            got = rows.get(name, [])
            if name == "documents":
                got = [r if len(r) == 5 else (r[0], r[1], "en", "src0", len(r[1] or "")) for r in got]
            table = pa.table({f.name: pa.array([r[k] for r in got], f.type) for k, f in enumerate(schema)}, schema=schema)
            for clash in ("pieces", "fp", "host", "path", "score", "component_id", "first", "label", "digest", "hash", "window", "size", "page", "h", "d", "n", "n_hit", "fold", "found") if extra else ():
                table = table.append_column(clash, pa.array(["kept"] * table.num_rows))
            pq.write_table(table, tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return build


@pytest.fixture(scope="session")
def sample():
    """Real rows of the smallest scale."""
    return {t: pq.read_table(f"/root/testdata/sf0.001/{t}.parquet").to_pylist() for t in ("documents", "pages", "benchmark", "labels")}
