"""Collections on Parquet: copy-on-write by hash bucket, with versioned manifests that are swapped in by a rename."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.model import DOC_SCHEMA, Collection, CollectionExists, CollectionNotFound, Field, RevisionConflict
from fathom.operators import mutations
from fathom.operators.bm25 import KeywordIndex

#: Buckets of a new collection, and bytes of Parquet beyond which a bucket is too large: a write reads and rewrites only the
#: buckets that its ids fall in, and doubles their number as long as they are too large on average.
BUCKETS, BUCKET_BYTES = 16, 128 << 20
CACHE = "model string, key string, embedding array<float>, prompt_tokens int, total_tokens int"
USAGE = "ts timestamp, tokens long, requests long"


class Files:
    """Small text files through Hadoop's file systems. New versions rest on a rename that fails if the name is taken, as on HDFS and local disks."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _open(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def write_new(self, path: str, text: str) -> bool:
        """False if the file is there already."""
        fs, p = self._open(path)
        if fs.exists(p):
            return False
        draft = self._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(p) or not fs.rename(draft, p):
            fs.delete(draft, False)
            return False
        return True

    def read(self, path: str) -> str:
        fs, p = self._open(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def bytes_under(self, path: str) -> int:
        fs, p = self._open(path)
        return fs.getContentSummary(p).getLength()

    def exists(self, path: str) -> bool:
        fs, p = self._open(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._open(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._open(path)
        fs.delete(p, True)


class Store:
    """Catalog and documents under one folder; embeddings that were paid for, and token usage, in a folder beside it."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, bucket_bytes: int = BUCKET_BYTES):
        self.spark, self.root, self.buckets, self.bucket_bytes, self.files = spark, root.rstrip("/"), buckets, bucket_bytes, Files(spark)
        self.system = f"{self.root}-system"

    # Collections.

    def create(self, collection: Collection) -> Collection:
        made = Collection(collection.name, collection.fields, collection.vector_dim, collection.created_at or int(time.time() * 1000))
        if not self.files.write_new(f"{self.root}/{made.name}/collection.json", json.dumps(asdict(made))):
            raise CollectionExists(made.name)
        return made

    def ensure(self, collection: Collection) -> Collection:
        """Creates it, or returns the one that is there, whatever its fields."""
        try:
            return self.create(collection)
        except CollectionExists:
            return self.get(collection.name)

    def get(self, name: str) -> Collection:
        if "collection.json" not in self.files.names(f"{self.root}/{name}"):
            raise CollectionNotFound(name)
        x = json.loads(self.files.read(f"{self.root}/{name}/collection.json"))
        return Collection(x["name"], tuple(Field(**f) for f in x["fields"]), x["vector_dim"], x["created_at"], x["revision"], x["type"])

    def list(self, cursor: str | None = None, limit: int = 0) -> list[Collection]:
        """In order of creation, behind the collection named by the cursor; an unknown cursor gives none, and limit 0 all."""
        found = sorted((self.get(n) for n in self.files.names(self.root) if "collection.json" in self.files.names(f"{self.root}/{n}")), key=lambda c: (c.created_at, c.name))
        if cursor is not None:
            at = next((i for i, c in enumerate(found) if c.name == cursor), None)
            found = found[at + 1 :] if at is not None else []
        return found[:limit] if limit else found

    def drop(self, name: str) -> None:
        """Removes the collection and its documents."""
        self.get(name)
        self.files.delete(f"{self.root}/{name}")

    # Documents.

    def _manifest(self, name: str) -> tuple[int, int, dict[str, list]]:
        """Version, number of buckets, and path and bytes of each bucket that holds documents."""
        self.get(name)
        versions = self._versions(name)
        if not versions:
            return 0, self.buckets, {}
        x = json.loads(self.files.read(f"{self.root}/{name}/manifests/{versions[-1]}"))
        return int(versions[-1].split(".")[0]), x["buckets"], x["files"]

    def _versions(self, name: str) -> list[str]:
        return [n for n in self.files.names(f"{self.root}/{name}/manifests") if n.endswith(".json")]

    def _load(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(DOC_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], DOC_SCHEMA)

    def read(self, name: str) -> DataFrame:
        """The documents as of the latest version."""
        return self._load(sorted(path for path, _ in self._manifest(name)[2].values()))

    def get_document(self, name: str, id_: str) -> DataFrame:
        """The row with an id, from its bucket alone."""
        _, buckets, files = self._manifest(name)
        key = self.spark.range(1).select(_bucket(F.lit(id_), buckets)).first()[0]
        held = files.get(str(key))
        return mutations.point_get(self._load([held[0]] if held else []), id_)

    def count(self, name: str) -> int:
        return self.read(name).count()

    def scan(self, name: str, prefix: str) -> DataFrame:
        """The documents whose ids start with a prefix, in order; the bounds reach the Parquet scan."""
        return mutations.prefix_scan(self.read(name), prefix)

    def _rewrite(self, name: str, changes: DataFrame, make: Callable[[DataFrame], DataFrame]) -> None:
        """Puts make(old rows) in the place of the buckets that changes touch, and commits if no one else has meanwhile."""
        version, buckets, files = self._manifest(name)
        now = buckets
        while sum(size for _, size in files.values()) > now * self.bucket_bytes:
            now *= 2
        if now > buckets:  # all rows are dealt anew, so that later writes touch small buckets
            touched = list(files)
        else:
            touched = [str(r[0]) for r in changes.select(_bucket(F.col("id"), buckets)).distinct().collect()]
        if changes.isEmpty():
            return
        old = self._load([files[b][0] for b in touched if b in files])
        place = f"{self.root}/{name}/data/{version + 1:012d}-{uuid.uuid4().hex}"
        rows = make(old).select([F.col(f.name).cast(f.dataType) for f in DOC_SCHEMA])
        rows.withColumn("bucket", _bucket(F.col("id"), now)).repartition(max(len(touched), now if now > buckets else 1), "bucket").write.partitionBy("bucket").parquet(place)
        written = {n.split("=")[1]: [f"{place}/{n}", self.files.bytes_under(f"{place}/{n}")] for n in self.files.names(place) if n.startswith("bucket=")}
        rest = {b: p for b, p in files.items() if b not in touched}
        if not self.files.write_new(f"{self.root}/{name}/manifests/{version + 1:012d}.json", json.dumps({"buckets": now, "files": rest | written})):
            self.files.delete(place)
            raise RevisionConflict(version + 1)

    def vacuum(self, name: str, keep: int = 2) -> int:
        """Deletes versions but the last `keep`, with the data and indexes that only they use. Gives the number of folders deleted."""
        versions, gone = self._versions(name), 0
        used, base = set(), f"{self.root}/{name}"
        for v in versions[-keep:]:
            used |= {path.split("/data/")[1].split("/")[0] for path, _ in json.loads(self.files.read(f"{base}/manifests/{v}"))["files"].values()}
        for v in versions[:-keep]:
            self.files.delete(f"{base}/manifests/{v}")
        for folder, kept in (("data", used), ("index", {v.split(".")[0] for v in versions[-keep:]})):
            for n in self.files.names(f"{base}/{folder}"):
                if n not in kept:
                    self.files.delete(f"{base}/{folder}/{n}")
                    gone += 1
        return gone

    # Keyword index.

    def index(self, name: str) -> KeywordIndex:
        """Writes the postings of the latest version; searches of that version read them."""
        version = self._manifest(name)[0]
        return KeywordIndex.write(self.read(name).select("id", "content"), f"{self.root}/{name}/index/{version:012d}")

    def keyword_index(self, name: str) -> KeywordIndex | None:
        """The postings of the latest version, if they were written."""
        path = f"{self.root}/{name}/index/{self._manifest(name)[0]:012d}"
        return KeywordIndex.read(self.spark, path) if self.files.exists(f"{path}/numbers/_SUCCESS") else None

    # Embeddings and usage.

    def cached(self) -> DataFrame:
        """Rows (model, key, embedding, prompt_tokens, total_tokens) of texts that were embedded before."""
        return self._table("embeddings", CACHE)

    def cache(self, rows: DataFrame) -> DataFrame:
        """Stores new rows and gives them back as stored."""
        place = f"{self.system}/embeddings/{uuid.uuid4().hex}"
        rows.write.parquet(place)
        return self.spark.read.schema(CACHE).parquet(place)

    def usage(self) -> DataFrame:
        return self._table("usage", USAGE)

    def used(self, at, tokens: int, requests: int = 1) -> None:
        self.spark.createDataFrame([(at, int(tokens), requests)], USAGE).coalesce(1).write.parquet(f"{self.system}/usage/{uuid.uuid4().hex}")

    def _table(self, name: str, schema: str) -> DataFrame:
        held = [f"{self.system}/{name}/{n}" for n in self.files.names(f"{self.system}/{name}")]
        return self.spark.read.schema(schema).parquet(*held) if held else self.spark.createDataFrame([], schema)

    # Writes.

    def upsert(self, name: str, docs: DataFrame, mode: str = "replace", order_col: str | None = None) -> None:
        """replace: new documents take the place of old ones. merge: fields that only the old one has survive. Of rows with
        one id the last by order_col wins."""
        docs = mutations.last_of_each(docs, order_col)
        put = {"replace": mutations.upsert_replace, "merge": mutations.upsert_merge}[mode]
        self._rewrite(name, docs, lambda old: put(old, _filled(docs)))

    def patch(self, name: str, patches: DataFrame) -> DataFrame:
        """Applies the sound patches; gives the status of all."""
        status = mutations.patch_status(self.read(name), patches)
        good = patches.join(status.where("status = 'ok'").select("id"), "id", "left_semi")
        self._rewrite(name, patches, lambda old: mutations.patch(old, good))
        return status

    def delete(self, name: str, ids: DataFrame) -> None:
        self._rewrite(name, ids, lambda old: mutations.delete(old, ids))


def _bucket(id_: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(buckets)).cast("int")


def _filled(docs: DataFrame) -> DataFrame:
    """Adds the columns of DOC_SCHEMA that are missing."""
    for f in DOC_SCHEMA:
        if f.name not in docs.columns:
            docs = docs.withColumn(f.name, F.lit(1 if f.name == "revision" else None).cast(f.dataType))
    return docs.select([f.name for f in DOC_SCHEMA])
