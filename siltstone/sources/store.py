"""The catalog of indexes and the documents in them.

An index is a folder: a manifest, immutable Parquet segments of ``(id, body)``
and a change log of JSON lines, one batch a folder. Its documents are the
segments' (the oldest wins an id), changed by the log in the order of ``seq``.
The manifest is replaced last in every operation, by one rename, so one that is
cut off leaves the former state; it also counts its changes and names the last
batch of a feed. Postings of a segment may be kept beside it.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.errors import DocumentAlreadyExists, DocumentNotFound, IndexAlreadyExists, IndexNotFound, InvalidDocument, SearchError, StorageError
from siltstone.functions import crc32_hex
from siltstone.sources.files import Files
from siltstone.sources.mapping import Mapping, id_error, typed
from siltstone.sources.segments import MergePolicy, Registry

BODY = "id string, body string"
LOG = "seq long, op string, id string, body string, crc string"
#: Term buckets of the postings of an index.
BUCKETS = 16


def first_of_each(rows: DataFrame, key: str, order: list) -> DataFrame:
    """One row a key, the first by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def merge_segments(rows: DataFrame) -> DataFrame:
    """``(id, body)`` of ``(segment_id, id, body)``: the oldest segment wins a repeated id."""
    return first_of_each(rows, "id", [F.col("segment_id")]).select("id", "body")


def apply_log(base: DataFrame, log: DataFrame) -> DataFrame:
    """``base`` after the changes of ``(seq, op, id, body)``; the last one of an id counts."""
    last = first_of_each(log, "id", [F.desc("seq")])
    kept = base.join(last.select("id"), "id", "left_anti")
    return kept.unionByName(last.where("op = 'add'").select("id", "body"))


def validate(batch: DataFrame, mapping: Mapping, existing: DataFrame | None = None) -> DataFrame:
    """``(seq, id, body, error)`` of a batch ``(seq, id, body)``: bad ids and bodies, later repeats, ids that exist."""
    v = F.try_parse_json("body")
    rows = batch.select("seq", F.trim("id").alias("id"), "body", F.coalesce(id_error(F.col("id")), mapping.error(v)).alias("error"))
    good = Window.partitionBy("id", F.col("error").isNull()).orderBy("seq")
    rows = rows.withColumn("error", F.when(F.col("error").isNotNull(), F.col("error")).when(F.row_number().over(good) > 1, F.lit("the id is repeated in the batch")))
    if existing is not None:
        there = existing.select(F.col("id").alias("_there")).distinct()
        rows = rows.join(there, rows["id"] == there["_there"], "left").withColumn("error", F.coalesce("error", F.when(F.col("_there").isNotNull(), F.lit("the document exists")))).drop("_there")
    return rows


class Store:
    """Indexes under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)
        self.files.mkdirs("")

    # catalog

    def create(self, name: str, mapping: Mapping | None = None, buckets: int = BUCKETS) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_-]{1,128}", name):
            raise SearchError(f"{name!r} is no index name: 1 to 128 letters, digits, - and _")
        if self.exists(name):
            raise IndexAlreadyExists(name)
        self._save(name, {"version": 1, "uid": uuid.uuid4().hex, "changes": 0, "feed": -1, "buckets": buckets, "mapping": (mapping or Mapping()).to_json(), "segments": [], "batches": [], "seq": 0, "registry": []})

    def exists(self, name: str) -> bool:
        return self.files.exists(f"{name}/manifest.json")

    def names(self) -> list[str]:
        return [n for n in self.files.names() if self.exists(n)]

    def delete(self, name: str) -> None:
        self.manifest(name)
        self.files.delete(name)

    def mapping(self, name: str) -> Mapping:
        return Mapping.from_json(self.manifest(name)["mapping"])

    def info(self, name: str) -> dict:
        return {"name": name, "document_count": self.bodies(name).count(), "fields": self.mapping(name).to_json()}

    def total_documents(self) -> int:
        return sum(self.bodies(n).count() for n in self.names())

    def manifest(self, name: str) -> dict:
        """What an index consists of, as it was last saved."""
        if not self.exists(name):
            raise IndexNotFound(name)
        return self.files.read_json(f"{name}/manifest.json")

    def _save(self, name: str, manifest: dict) -> None:
        manifest["updated"] = time.time()
        manifest["changes"] = manifest.get("changes", 0) + 1
        manifest["segments"] = sorted(set(manifest["segments"]))
        self.files.write_json(f"{name}/manifest.json", manifest)

    def missing_segments(self, name: str) -> list[int]:
        """Segments of the manifest whose files are gone."""
        return [s for s in self.manifest(name)["segments"] if not self.files.exists(f"{name}/segments/{s:06d}")]

    # reading

    def segments(self, name: str, ids: list[int] | None = None) -> DataFrame:
        """``(segment_id, id, body)`` of the live segments, or some of them."""
        manifest = self.manifest(name)
        unknown = set(ids or []) - set(manifest["segments"])
        if unknown:
            raise StorageError(f"no segments {sorted(unknown)} in {name}")
        paths = [f"{self.files.root}/{name}/segments/{s:06d}" for s in (manifest["segments"] if ids is None else ids)]
        if not paths:
            return self.spark.createDataFrame([], f"segment_id int, {BODY}")
        # One scan, however many segments; the number is in the file's path.
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/segments/(\d+)/[^/]*$", 1).cast("int")
        return self.spark.read.schema(BODY).parquet(*paths).select(number.alias("segment_id"), "id", "body")

    def log(self, name: str) -> DataFrame:
        """The change log, up to the first line that is damaged."""
        batches = [f"{self.files.root}/{name}/log/{b:08d}" for b in self.manifest(name)["batches"]]
        if not batches:
            return self.spark.createDataFrame([], LOG)
        rows = self.spark.read.schema(LOG).json(batches)
        bad = rows.where(F.col("seq").isNull() | F.col("crc").isNull() | (F.col("crc") != _line_crc())).agg(F.min(F.coalesce("seq", F.lit(0))).alias("seq")).first()["seq"]
        if bad is None:
            return rows
        # A line without a number hides its place: only the batches before its own can be trusted.
        return rows.where(F.col("seq") < bad) if bad else self._before_damage(batches)

    def _before_damage(self, batches: list[str]) -> DataFrame:
        good = self.spark.createDataFrame([], LOG)
        for b in batches:
            rows = self.spark.read.schema(LOG).json(b)
            if not rows.where(F.col("seq").isNull() | F.col("crc").isNull() | (F.col("crc") != _line_crc())).isEmpty():
                break
            good = good.union(rows)
        return good

    def bodies(self, name: str) -> DataFrame:
        """``(id, body)`` of all documents."""
        return apply_log(merge_segments(self.segments(name)), self.log(name))

    def documents(self, name: str) -> DataFrame:
        """``(document_id, declared fields, extra)`` of all documents."""
        return typed(self.bodies(name), self.mapping(name))

    def get(self, name: str, document_id: str) -> str:
        row = self.bodies(name).where(F.col("id") == document_id).first()
        if row is None:
            raise DocumentNotFound(document_id)
        return row["body"]

    # writing

    def version(self, name: str) -> tuple[str, int]:
        """What differs after every change, also if an index of the same name is made anew."""
        manifest = self.manifest(name)
        return manifest.get("uid", ""), manifest.get("changes", 0)

    def feed_batch(self, name: str) -> int:
        """The last batch of a feed that was applied, -1 before the first."""
        return self.manifest(name).get("feed", -1)

    def _append(self, name: str, rows: DataFrame, feed: int | None = None) -> None:
        """Add ``(seq, op, id, body)`` to the log as one batch; ``seq`` counts on from what is there.

        ``feed`` is the batch of a feed that it is; both become visible at once.
        """
        manifest = self.manifest(name)
        batch = max(manifest["batches"], default=0) + 1
        path = f"{self.files.root}/{name}/log/{batch:08d}"
        numbered = rows.withColumn("seq", F.col("seq") + manifest["seq"] + 1)
        numbered.withColumn("crc", _line_crc()).select("seq", "op", "id", "body", "crc").write.mode("overwrite").json(path)
        last = self.spark.read.schema(LOG).json(path).agg(F.max("seq")).first()[0]
        manifest["batches"].append(batch)
        manifest["feed"] = manifest.get("feed", -1) if feed is None else feed
        manifest["seq"] = last or manifest["seq"]
        self._save(name, manifest)

    def bulk_add(self, name: str, batch: DataFrame) -> DataFrame:
        """Add ``(seq, id, body)``; ``(seq, id, status, error)`` for each row, ``created`` or ``error``.

        Bad rows never stop the others. The first of repeated ids is added.
        """
        path = f"{self.files.root}/{name}/results/{time.time_ns()}"
        validate(batch, self.mapping(name), self.bodies(name)).write.parquet(path)
        checked = self.spark.read.parquet(path)
        self._append(name, checked.where("error is null").select("seq", F.lit("add").alias("op"), "id", "body"))
        return checked.select("seq", "id", F.when(F.col("error").isNull(), "created").otherwise("error").alias("status"), "error")

    def add(self, name: str, document_id: str, body: str) -> None:
        result = self.bulk_add(name, self.spark.createDataFrame([(0, document_id, body)], "seq long, id string, body string")).first()
        if result["status"] == "error":
            raise (DocumentAlreadyExists if result["error"] == "the document exists" else InvalidDocument)(f"{document_id}: {result['error']}")

    def remove(self, name: str, document_id: str) -> None:
        self.get(name, document_id)
        self._append(name, self.spark.createDataFrame([(0, "remove", document_id, None)], "seq long, op string, id string, body string"))

    def bulk_remove(self, name: str, ids: DataFrame) -> None:
        """Remove the documents of ``(id)`` in one batch; ids that aren't there are passed over."""
        there = self.bodies(name).select("id").join(ids.select("id").distinct(), "id", "left_semi")
        self._append(name, there.select(F.lit(0).cast("long").alias("seq"), F.lit("remove").alias("op"), "id", F.lit(None).cast("string").alias("body")))

    # maintenance

    def _segment(self, name: str, rows: DataFrame, manifest: dict) -> int:
        registry = Registry.from_json(manifest["registry"])
        number = max(registry.next_id(), max(manifest["segments"], default=0) + 1)
        path = f"{name}/segments/{number:06d}"
        # No manifest names this number, so what is there was left by a writer that died.
        rows.select("id", "body").write.mode("overwrite").parquet(f"{self.files.root}/{path}")
        count = self.spark.read.parquet(f"{self.files.root}/{path}").count()
        registry.add(number, count, self.files.size(path))
        manifest["registry"] = registry.to_json()
        return number

    def flush(self, name: str) -> int:
        """Write the log's additions as a segment if they are all new, else all documents as one; the log is empty then."""
        manifest, log = self.manifest(name), self.log(name)
        if log.isEmpty():
            return 0
        changed = log.where("op = 'remove'").select("id").union(self.segments(name).join(log, "id", "left_semi").select("id"))
        if not changed.isEmpty():
            return self.compact(name)
        number = self._segment(name, first_of_each(log, "id", [F.desc("seq")]), manifest)
        done, manifest["batches"] = manifest["batches"], []
        manifest["segments"].append(number)
        self._save(name, manifest)
        for b in done:
            self.files.delete(f"{name}/log/{b:08d}")
        return number

    def compact(self, name: str, ids: list[int] | None = None) -> int:
        """Merge all segments and the log, or some segments, into a new one."""
        manifest = self.manifest(name)
        if ids is not None and len(set(ids)) < 2:
            raise StorageError("a merge takes two segments at least")
        rows = self.bodies(name) if ids is None else merge_segments(self.segments(name, sorted(set(ids))))
        number = self._segment(name, rows, manifest)
        gone = [s for s in manifest["segments"] if ids is None or s in ids]
        manifest["segments"] = [s for s in manifest["segments"] if s not in gone] + [number]
        registry = Registry.from_json(manifest["registry"])
        registry.mark([s for s in gone if any(e["segment_id"] == s for e in manifest["registry"])], "deleted")
        manifest["registry"] = registry.to_json()
        batches = []
        if ids is None:
            batches, manifest["batches"] = manifest["batches"], []
        self._save(name, manifest)
        for s in gone:
            self._drop_files(name, s)
        for b in batches:
            self.files.delete(f"{name}/log/{b:08d}")
        self.files.clear_temporary(name)
        return number

    def _drop_files(self, name: str, segment: int) -> None:
        for path in (f"segments/{segment:06d}", f"postings/segment={segment}", f"lengths/segment={segment}"):
            self.files.delete(f"{name}/{path}")

    def replace(self, name: str, rows: DataFrame, ids: list[int]) -> int:
        """Put a new segment of ``(id, body)`` in the place of some segments; the log stays."""
        manifest = self.manifest(name)
        unknown = set(ids) - set(manifest["segments"])
        if unknown:
            raise StorageError(f"no segments {sorted(unknown)} in {name}")
        number = self._segment(name, rows, manifest)
        manifest["segments"] = [s for s in manifest["segments"] if s not in ids] + [number]
        self._mark(manifest, ids, "deleted")
        self._save(name, manifest)
        for s in ids:
            self._drop_files(name, s)
        return number

    def delete_segment(self, name: str, segment: int) -> None:
        """Drop one segment and its documents."""
        manifest = self.manifest(name)
        if segment not in manifest["segments"]:
            raise StorageError(f"no segments [{segment}] in {name}")
        manifest["segments"].remove(segment)
        self._mark(manifest, [segment], "deleted")
        self._save(name, manifest)
        self._drop_files(name, segment)

    def mark_merging(self, name: str, ids: list[int]) -> None:
        """Say that segments are being merged; they are still read."""
        manifest = self.manifest(name)
        self._mark(manifest, ids, "merging")
        self._save(name, manifest)

    def sync(self, name: str) -> list[int]:
        """Make the manifest name the segments that the registry holds as live and whose files are there; what it named wrongly."""
        manifest = self.manifest(name)
        live = [s.segment_id for s in Registry.from_json(manifest["registry"]).active() if self.files.exists(f"{name}/segments/{s.segment_id:06d}")]
        wrong = sorted(set(manifest["segments"]) ^ set(live))
        if wrong:
            manifest["segments"] = live
            self._save(name, manifest)
        return wrong

    @staticmethod
    def _mark(manifest: dict, ids: list[int], state: str) -> None:
        registry = Registry.from_json(manifest["registry"])
        registry.mark(ids, state)
        manifest["registry"] = registry.to_json()

    def compact_if_due(self, name: str, policy: MergePolicy | None = None) -> list[int]:
        """Merge what the policy picks; the ids that were merged."""
        ids = (policy or MergePolicy()).pick(Registry.from_json(self.manifest(name)["registry"]).active())
        if len(ids) > 1:
            self.compact(name, ids)
        return ids

    def snapshot(self, name: str, path: str) -> None:
        """A copy of the documents, with its own checksum, that ``restore`` verifies."""
        self.bodies(name).write.mode("overwrite").parquet(f"{path}/documents")
        count, total = _checksum(self.spark.read.schema(BODY).parquet(f"{path}/documents"))
        Files(self.spark, path).write_json("snapshot.json", {"name": name, "mapping": self.mapping(name).to_json(), "documents": count, "checksum": total})

    def restore(self, path: str, name: str | None = None) -> str:
        """An index made from a snapshot; a damaged one raises StorageError."""
        head = Files(self.spark, path).read_json("snapshot.json")
        rows = self.spark.read.schema(BODY).parquet(f"{path}/documents")
        if _checksum(rows) != (head["documents"], head["checksum"]):
            raise StorageError("the snapshot fails its checksum")
        name = name or head["name"]
        self.create(name, Mapping.from_json(head["mapping"]))
        manifest = self.manifest(name)
        manifest["segments"].append(self._segment(name, rows, manifest))
        self._save(name, manifest)
        return name


def _line_crc():
    return crc32_hex(F.concat_ws("\u0001", F.col("seq").cast("string"), "op", "id", F.coalesce("body", F.lit(""))))


def _checksum(rows: DataFrame) -> tuple[int, int]:
    got = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.crc32(F.concat_ws("\u0001", "id", "body"))), F.lit(0)).alias("c")).first()
    return got["n"], got["c"]
