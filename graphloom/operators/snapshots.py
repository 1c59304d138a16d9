"""What changed between full snapshots."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTRY = "project_id string, path string, current int, revision long, sha256 string"


def normal_path(path: str) -> str:
    """With `/`, without leading `./`, in NFC."""
    path = path.replace("\\", "/")
    while path.startswith("./"):
        path = path[2:].lstrip("/")
    return path if path.isascii() else unicodedata.normalize("NFC", path)


def _read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["project_id", "path", "current", "revision", "sha256"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string()]
    for batch in batches:
        for project, revision, text in zip(*(batch.column(i) for i in range(3))):
            try:
                sources = json.loads(text.as_py() or "null")["sources"]
            except (ValueError, TypeError, KeyError):
                continue
            entries: dict[str, str] = {}
            for s in sources if isinstance(sources, list) else ():
                if isinstance(s, dict) and isinstance(s.get("path"), str):
                    sha, path = str(s.get("sha256") or "").lower(), normal_path(s["path"])
                    entries[path] = max(sha, entries.get(path, ""))
            if entries:
                n = len(entries)
                columns = ([project.as_py()] * n, list(entries), [0] * n, [revision.as_py()] * n, list(entries.values()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _normal_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        i = batch.schema.get_field_index("path")
        yield batch.set_column(i, "path", pa.array([None if p is None else normal_path(p) for p in batch.column(i).to_pylist()], pa.string()))


def archived_entries(history: DataFrame) -> DataFrame:
    """One row per snapshot and path from JSON documents (project_id, revision, document).

    An entry listed twice counts once, with the greater hash. Documents that are null, no JSON or without sources
    have no entries. Rows of a revision delivered twice are united.
    """
    return history.select("project_id", "revision", "document").mapInArrow(_read_documents, ENTRY)


def readable() -> Column:
    """Whether a snapshot's document (column document) is JSON with a list of sources."""
    return F.json_array_length(F.get_json_object("document", "$.sources")).isNotNull()


def bad_documents(history: DataFrame) -> DataFrame:
    """project_id, revision and snapshot_id of archived snapshots of which no row has a readable document."""
    rows = history.groupBy("project_id", "revision").agg(F.max(readable()).alias("_good"), F.max("snapshot_id").alias("snapshot_id"))
    return rows.where("not _good").select("project_id", "revision", "snapshot_id")


def chain(revisions: DataFrame) -> DataFrame:
    """(project_id, current, revision) with prev_revision and next_revision of the snapshot before and after it."""
    order = Window.partitionBy("project_id").orderBy("current", "revision")
    return (
        revisions.distinct()
        .withColumn("prev_revision", F.lag("revision").over(order))
        .withColumn("next_revision", F.lead("revision").over(order))
    )


def _merge(fields: list[str]):
    """A streaming two-pointer merge: rows come sorted by project, path and snapshot, so the entries that consecutive
    snapshots have of a key stand side by side; neighbours are compared and typed changes emitted."""
    key = ["project_id", "path"]
    at = [*key, "current", "revision"]
    out = pa.schema([("project_id", pa.string()), ("from_revision", pa.int64()), ("to_revision", pa.int64()), ("path", pa.string()), ("change_kind", pa.string()), ("changed_fields", pa.list_(pa.string()))])

    def differs(a: pa.Table, b: pa.Table, names: list[str]) -> list[pa.ChunkedArray]:
        result = []
        for n in names:
            x, y = a[n], b[n]
            unlike = pc.fill_null(pc.not_equal(x, y), False)
            result.append(pc.or_(unlike, pc.xor(pc.is_null(x), pc.is_null(y))))
        return result

    def some(parts: list[pa.ChunkedArray]) -> pa.ChunkedArray:
        result = parts[0]
        for p in parts[1:]:
            result = pc.or_(result, p)
        return result

    def emit(rows: pa.Table, mask, kind: str, old: str, new: str, changed=None) -> Iterator[pa.RecordBatch]:
        t = rows.filter(mask)
        if t.num_rows:
            lists = pa.array([[] for _ in range(t.num_rows)] if changed is None else changed, pa.list_(pa.string()))
            done = pa.table([t["project_id"], t[old], t[new], t["path"], pa.array([kind] * t.num_rows), lists], schema=out)
            yield from done.combine_chunks().to_batches()

    def ends(rows: pa.Table, first, last) -> Iterator[pa.RecordBatch]:
        """Rows whose key is absent from the snapshot before (first) or after (last) them."""
        yield from emit(rows, pc.and_(first, pc.is_valid(rows["prev_revision"])), "added", "prev_revision", "revision")
        yield from emit(rows, pc.and_(last, pc.is_valid(rows["next_revision"])), "removed", "revision", "next_revision")

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """rows: at least two, without repeats; the first was seen before, as far as what precedes it."""
        a, b = rows.slice(0, rows.num_rows - 1), rows.slice(1)
        other = some(differs(a, b, key))
        gap = pc.or_(other, pc.fill_null(pc.not_equal(a["revision"], b["prev_revision"]), True))
        no = pa.chunked_array([pa.array([False] * a.num_rows)])
        yield from ends(a, no, gap)
        yield from ends(b, gap, no)
        unlike = differs(a, b, fields)
        mask = pc.and_(pc.invert(gap), some(unlike))
        if pc.any(mask).as_py():
            flags = [pc.filter(u, mask).to_pylist() for u in unlike]
            both = b.append_column("_from", a["revision"])
            yield from emit(both, mask, "changed", "_from", "revision", [[f for f, u in zip(fields, row) if u] for row in zip(*flags)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last row compared so far and the row after it, which a repeat may yet replace
        begun = False
        yes, no = pa.chunked_array([pa.array([True])]), pa.chunked_array([pa.array([False])])

        def ready(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            if rows.num_rows and not begun:
                yield from ends(rows.slice(0, 1), yes, no)
            if rows.num_rows > 1:
                yield from pairs(rows)

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            n = rows.num_rows
            if not n:
                continue
            if n > 1:  # of repeats the last stays
                rows = rows.filter(pa.chunked_array([*some(differs(rows.slice(0, n - 1), rows.slice(1), at)).chunks, pa.array([True])]))
                n = rows.num_rows
            rows = rows.combine_chunks()
            yield from ready(rows.slice(0, n - 1))
            begun |= n > 1
            held = rows.slice(max(0, n - 2))
        if held is not None:
            yield from ready(held)
            yield from ends(held.slice(held.num_rows - 1), no, yes)

    return run


def snapshot_changes(entries: DataFrame, fields: list[str], partitions: int | None = None) -> DataFrame:
    """Typed changes between consecutive snapshots.

    entries: project_id, path (the key), current and revision (the snapshot), prev_revision and next_revision (see
    chain) and the compared fields. Returns project_id, from_revision, to_revision, path, change_kind (`added`,
    `removed`, `changed`) and changed_fields. Keys are compared exactly, fields null-safely. Repeated rows of a key in a
    snapshot count once, with the greatest fields. The rows are range-partitioned and sorted by key, so ranges are even
    whatever the size of a project, and each is merged in one pass with one row in memory beside the batch.
    """
    order = ["project_id", "path", "current", "revision"]
    spread = entries.repartitionByRange(partitions, "project_id", "path") if partitions else entries.repartitionByRange("project_id", "path")
    rows = spread.select(*order, "prev_revision", "next_revision", *fields).sortWithinPartitions(*order, *fields)
    return rows.mapInArrow(_merge(fields), "project_id string, from_revision long, to_revision long, path string, change_kind string, changed_fields array<string>")


def map_changes(history: DataFrame, sample_map: DataFrame) -> DataFrame:
    """Changes of files between a project's archived snapshots in order of revision, then its current map.

    history: project_id, revision, document. sample_map: id, project_id, revision, path, sha256, delivered_at; the row
    with the latest delivered_at holds for an id, and a project's greatest revision stands for its current map. Revisions
    without a readable document are left out of the chain: what they held is unknown (see bad_documents).
    """
    from graphloom.operators.latest import latest_per_key

    current = latest_per_key(sample_map, ["id"], ["delivered_at"], ["project_id", "revision", "path", "sha256"])
    latest = current.groupBy("project_id").agg(F.max("revision").alias("revision")).select("project_id", F.lit(1).alias("current"), "revision")
    revisions = chain(history.where(readable()).select("project_id", F.lit(0).alias("current"), "revision").unionByName(latest))
    archived = archived_entries(history).join(revisions.where("current = 0"), ["project_id", "current", "revision"])
    now = current.where("path is not null").select("project_id", "path", F.lit(1).alias("current"), F.lower("sha256").alias("sha256"))
    now = now.mapInArrow(_normal_paths, now.schema).join(revisions.where("current = 1"), ["project_id", "current"])
    return snapshot_changes(archived.unionByName(now), ["sha256"])
