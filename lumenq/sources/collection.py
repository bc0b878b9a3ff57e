"""A mutable collection of records: immutable folders of Parquet, and a numbered file per version that
names the folders it consists of.

Each change writes a log folder of put and delete rows, then the next version's file, which only one
writer can make: it is written aside and renamed to its name, and the rename fails if the name is
taken. The loser of such a race starts again from the version it lost to. The live view is, per id, the row
of the newest version; a reader opened at a version number keeps seeing that snapshot and can't write.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.functions.codecs import canonical, element_type
from lumenq.functions.metrics import parse
from lumenq.operators.lexical import is_sparse, sound_sparse
from lumenq.util import hadoop_path


class EngineError(Exception):
    code = "internal"


class AlreadyExists(EngineError):
    code = "already_exists"


class NotFound(EngineError):
    code = "not_found"


class DuplicateRecordId(EngineError):
    code = "duplicate_record_id"


class InvalidRecord(EngineError):
    code = "invalid_record"


class ReadOnly(EngineError):
    code = "read_only"


class Conflict(EngineError):
    code = "conflict"


@dataclass
class Spec:
    """What is fixed when a collection is made."""

    metric: str = "euclidean"
    dimensions: int = 0
    element_type: str = "float32"
    text: bool = False
    tokenizer: str = "unicode"
    named: dict[str, dict] = field(default_factory=dict)  # name -> {"kind": dense, sparse or late, "metric", "dimensions"}


SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("text", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("named", T.MapType(T.StringType(), T.ArrayType(T.FloatType()))),
        T.StructField("sparse", T.MapType(T.StringType(), T.StructType([T.StructField("indices", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.FloatType()))]))),
        T.StructField("multi", T.MapType(T.StringType(), T.ArrayType(T.ArrayType(T.FloatType())))),
    ]
)
KINDS = {"dense": "named", "sparse": "sparse", "late": "multi"}  # where the named vectors of a kind are kept
LOG = T.StructType([*SCHEMA.fields, T.StructField("deleted", T.BooleanType(), False), T.StructField("version", T.LongType(), False), T.StructField("seq", T.LongType())])
ATTEMPTS = 20


class Collection:
    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs, _ = hadoop_path(spark, self.path)
        self._p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.pinned = version is not None
        self._load(version)

    def _load(self, version: int | None = None) -> None:
        """The state of a version, the newest by default."""
        folder = self._p(f"{self.path}/versions")
        if not self._fs.exists(folder):
            raise NotFound(self.path)
        known = [int(n[:-5]) for f in self._fs.listStatus(folder) if (n := f.getPath().getName()).endswith(".json") and n[0] != "."]
        if not known or (version is not None and version not in known):
            raise NotFound(f"{self.path} version {version}")
        self.version = max(known) if version is None else version
        self._state = json.loads(self._read(self._file(self.version)))
        self.spec = Spec(**self._state["spec"])

    @staticmethod
    def _file(version: int) -> str:
        return f"versions/{version:012d}.json"

    # making and opening

    @classmethod
    def create(cls, spark: SparkSession, path: str, spec: Spec) -> Collection:
        parse(spec.metric)
        element_type(spec.element_type)
        if spec.dimensions <= 0:
            raise InvalidRecord("dimensions must be greater than zero")
        for name, of in spec.named.items():
            if not name or name.startswith("@") or of.get("kind") not in KINDS or (of["kind"] != "sparse" and of.get("dimensions", 0) <= 0):
                raise InvalidRecord(f"named vector {name!r} needs a kind (dense, sparse, late) and dimensions")
            parse(of.get("metric", "inner-product"))
        fs, folder = hadoop_path(spark, f"{path.rstrip('/')}/versions")
        if fs.exists(folder):
            raise AlreadyExists(path)
        fs.mkdirs(folder)
        try:
            _write_once(spark, path.rstrip("/"), cls._file(0), json.dumps({"spec": asdict(spec), "folders": [], "batches": {}}))
        except Conflict as e:
            raise AlreadyExists(path) from e
        return cls(spark, path)

    open = __init__

    def refresh(self) -> Collection:
        return Collection(self.spark, self.path)

    def _read(self, name: str) -> str:
        s = self._fs.open(self._p(f"{self.path}/{name}"))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8")
        s.close()
        return text

    def _change(self, make) -> None:  # noqa: ANN001
        """Makes the next version: make() writes folders and gives (folders, changes of the state) from
        the newest state, or None for no change. If another writer was first, all starts again."""
        if self.pinned:
            raise ReadOnly(f"{self.path} is open at version {self.version}")
        for _ in range(ATTEMPTS):
            self._load()
            made = make()
            if made is None:
                return
            folders, more = made
            state = self._state | more | {"folders": folders}
            try:
                _write_once(self.spark, self.path, self._file(self.version + 1), json.dumps(state))
            except Conflict:
                known = {n for n, _ in self._state["folders"]}
                for name, _ in folders:
                    if name not in known:
                        self._fs.delete(self._p(f"{self.path}/{name}"), True)
                continue
            self._state, self.version = state, self.version + 1
            return
        raise Conflict(f"{self.path}: {ATTEMPTS} other writers were first")

    # reading

    def log(self) -> DataFrame:
        """All rows of this snapshot, old versions and tombstones included."""
        paths = [f"{self.path}/{name}" for name, _ in self._state["folders"]]
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def newest(self) -> DataFrame:
        """Per id the row of the newest version; seq is the largest of all its rows."""
        rest = [c for c in LOG.fieldNames() if c not in ("id", "seq")]
        return self.log().groupBy("id").agg(F.max_by(F.struct(*rest), F.col("version")).alias("r"), F.max("seq").alias("seq")).select("id", "r.*", "seq")

    def live(self) -> DataFrame:
        """The live records."""
        return self.newest().where("NOT deleted").drop("deleted", "version", "seq")

    def stats(self) -> DataFrame:
        """One row: records, vectors, sparse_vectors, texts, tombstones, version."""
        n = self.newest()
        alive = ~F.col("deleted")
        return n.agg(
            F.count_if(alive).alias("records"),
            F.count_if(alive & F.col("vector").isNotNull()).alias("vectors"),
            F.count_if(alive & F.coalesce(is_sparse(F.col("vector")), F.lit(False))).alias("sparse_vectors"),
            F.count_if(alive & F.col("text").isNotNull()).alias("texts"),
            F.count_if("deleted").alias("tombstones"),
            F.lit(self.version).alias("version"),
        )

    # changing

    def _checked(self, records: DataFrame) -> DataFrame:
        have = set(records.columns)
        if "id" not in have:
            raise InvalidRecord("records need an id")
        if "text" in have and not self.spec.text and not records.where("text IS NOT NULL").isEmpty():
            raise InvalidRecord("the collection has no text")
        shaped = records.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA.fields])
        finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        bad = F.col("id").isNull() | (F.col("id") == "") | F.coalesce((F.size("vector") != self.spec.dimensions) | ~finite, F.lit(False)) | self._bad_named()
        first = shaped.where(bad).limit(1).collect()
        if first:
            raise InvalidRecord(f"empty id, wrong length, unknown name or non-finite value: {first[0]['id']!r}")
        return shaped.withColumn("vector", canonical(F.col("vector"), self.spec.element_type))

    def _bad_named(self) -> Column:
        """Whether a named vector isn't one that the collection was made with."""
        bad = F.lit(False)
        sound = lambda v: F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        for kind, column in KINDS.items():
            known = {n: of for n, of in self.spec.named.items() if of["kind"] == kind}
            bad = bad | F.coalesce(F.exists(F.map_keys(column), lambda n: ~n.isin(list(known))), F.lit(False))
            for n, of in known.items():
                v = F.try_element_at(column, F.lit(n))
                if kind == "dense":
                    wrong = (F.size(v) != of["dimensions"]) | ~sound(v)
                elif kind == "late":
                    wrong = ~F.forall(v, _token_of(of["dimensions"], sound))
                else:
                    wrong = ~sound_sparse(v)
                bad = bad | F.coalesce(v.isNotNull() & wrong, F.lit(False))
        return bad

    def vectors_of(self, name: str, rows: DataFrame | None = None) -> DataFrame:
        """id and vector (of its kind) of the live records, or of rows of such, that have the named vector."""
        if name not in self.spec.named:
            raise NotFound(f"named vector {name!r}")
        v = F.try_element_at(KINDS[self.spec.named[name]["kind"]], F.lit(name))
        return (self.live() if rows is None else rows).select("id", v.alias("vector")).where("vector IS NOT NULL")

    def _appended(self, *parts: tuple[DataFrame, bool]) -> list:
        """Writes rows to put and rows to delete, an id in one of them at most; the folders with these."""
        folders = list(self._state["folders"])
        for rows, deleted in parts:
            name = f"log-{self.version + 1:012d}-{uuid.uuid4().hex[:8]}"
            seq = F.col("seq") if "seq" in rows.columns else F.lit(None).cast("bigint")
            rows.select(*SCHEMA.fieldNames(), F.lit(deleted).alias("deleted"), F.lit(self.version + 1).cast("bigint").alias("version"), seq.alias("seq")).write.parquet(f"{self.path}/{name}")
            folders.append([name, self.version + 1])
        return folders

    def add(self, records: DataFrame) -> None:
        """Inserts new records; ids that repeat, live or deleted (until purged), are an error."""
        shaped = self._checked(records)

        def make() -> tuple[list, dict]:
            twice = shaped.groupBy("id").count().where("count > 1").limit(1).collect()
            known = shaped.select("id").join(self.log().select("id"), "id", "left_semi").limit(1).collect()
            if twice or known:
                raise DuplicateRecordId((twice or known)[0]["id"])
            return self._appended((shaped, False)), {}

        self._change(make)

    def add_vectors(self, vectors: DataFrame) -> DataFrame:
        """Inserts vectors without ids; returns them with the ids made for them."""
        made = vectors.select(F.concat(F.lit("g"), F.sha2(F.concat(F.lit(f"{self.version}-"), F.expr("uuid()")), 256)).alias("id"), "vector")
        self._change(lambda: (self._appended((self._checked(made), False)), {}))
        return self.spark.read.schema(LOG).parquet(f"{self.path}/{self._state['folders'][-1][0]}").select("id", "vector")

    def _puts(self, records: DataFrame) -> DataFrame:
        w = Window.partitionBy("id").orderBy(F.xxhash64(F.to_json(F.struct(*SCHEMA.fieldNames()))).desc())
        return self._checked(records).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")

    def upsert(self, records: DataFrame) -> None:
        """Inserts or replaces; of rows with the same id in one call any one wins. Revives deleted ids."""
        self._change(lambda: (self._appended((self._puts(records), False)), {}))

    def _drops(self, ids: DataFrame, live: bool = True) -> DataFrame:
        gone = ids.select(F.col("id").cast("string").alias("id")).distinct()
        gone = gone.join(self.live().select("id"), "id", "left_semi") if live else gone
        return gone.select("id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMA.fields[1:]])

    def delete(self, ids: DataFrame) -> int:
        """Deletes the live ones among ids (repeated ones count once); returns how many there were."""
        n = 0

        def make() -> tuple[list, dict] | None:
            nonlocal n
            rows = self._drops(ids)
            n = rows.count()
            return (self._appended((rows, True)), {}) if n else None

        self._change(make)
        return n

    def apply(self, changes: DataFrame, batch: int, stream: str = "") -> None:
        """A batch of a stream as one version, once per stream and batch number.

        changes: the columns of a record, op (put or delete) and seq. Per id the change of the largest
        seq counts, over all batches and streams: one that is not above the largest seq applied to its
        id before is left out, whatever the order of arrival. Deletes are kept as tombstones, known id
        or not, for the changes that arrive later than they should. Direct changes (upsert, delete)
        have no seq and are not held back by one.
        """

        def make() -> tuple[list, dict] | None:
            if batch <= self._state["batches"].get(stream, -1):
                return None
            rest = [c for c in changes.columns if c != "id"]
            last = changes.groupBy("id").agg(F.max_by(F.struct(*rest), F.col("seq")).alias("r")).select("id", "r.*")
            known = self.log().where("seq IS NOT NULL").groupBy("id").agg(F.max("seq").alias("__seen"))
            fresh = last.join(known, "id", "left").where("__seen IS NULL OR seq > __seen").drop("__seen")
            seqs = fresh.select("id", "seq")
            puts = self._checked(fresh.where("op = 'put'")).join(seqs, "id")
            drops = self._drops(fresh.where("op = 'delete'"), live=False).join(seqs, "id")
            return self._appended((puts, False), (drops, True)), {"batches": self._state["batches"] | {stream: batch}}

        self._change(make)

    def purge(self) -> None:
        """Rewrites the live records; tombstones, old versions and sequences go, their ids may be added again."""

        def make() -> tuple[list, dict]:
            name = f"base-{self.version + 1:012d}-{uuid.uuid4().hex[:8]}"
            self.live().select(*SCHEMA.fieldNames(), F.lit(False).alias("deleted"), F.lit(self.version + 1).cast("bigint").alias("version"), F.lit(None).cast("bigint").alias("seq")).write.parquet(f"{self.path}/{name}")
            return [[name, self.version + 1]], {}

        self._change(make)

    def compact(self, rows_per_file: int = 131_072) -> None:
        """Rewrites all folders into one, rows that are near each other together; tombstones stay."""
        if rows_per_file <= 0:
            raise ValueError("rows_per_file must be greater than zero")

        def make() -> tuple[list, dict]:
            name = f"base-{self.version + 1:012d}-{uuid.uuid4().hex[:8]}"
            n = self.newest().withColumn("__at", locality("vector"))
            n.repartitionByRange("__at", "id").sortWithinPartitions("__at", "id").drop("__at").select(*LOG.fieldNames()).write.option("maxRecordsPerFile", rows_per_file).parquet(f"{self.path}/{name}")
            return [[name, self.version + 1]], {}

        self._change(make)

    rebuild = compact

    def finish_bulk_load(self, **how: object) -> None:
        """Builds the coarse index of the live records' vectors and keeps it with the collection; any
        later change makes it stale, until this is called again. how: of ivf.build."""
        from lumenq.operators import ivf

        def make() -> tuple[list, dict]:
            name = f"cells-{self.version + 1:012d}-{uuid.uuid4().hex[:8]}"
            ivf.build(self.live().select("id", "vector", "metadata"), self.spec.metric, path=f"{self.path}/{name}", **how)
            return self._state["folders"], {"cells": [name, self.version + 1]}

        self._change(make)

    def cells(self):  # noqa: ANN201
        """The kept coarse index, or None if there is none of this version."""
        from lumenq.operators import ivf

        name, version = self._state.get("cells", [None, None])
        if version != self.version:
            return None
        shape = T.StructType([T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("metadata", T.StringType()), T.StructField("cell_id", T.IntegerType())])
        return ivf.open_cells(self.spark, f"{self.path}/{name}", self.spec.metric, shape)

    def flush(self) -> None:
        """Changes are durable when their call returns; nothing is held back."""

    def gc(self, *, dry_run: bool = True, min_age_seconds: float = 86_400) -> list[str]:
        """Folders that the current version doesn't name and that are old enough; removed unless dry_run."""
        import time

        held = {n for n, _ in [*self._state["folders"], self._state.get("cells", [None, None])]}
        out = []
        for s in self._fs.listStatus(self._p(self.path)):
            name = s.getPath().getName()
            if name.startswith(("log-", "base-", "cells-")) and name not in held and time.time() - s.getModificationTime() / 1000 >= min_age_seconds:
                out.append(name)
                if not dry_run:
                    self._fs.delete(s.getPath(), True)
        return sorted(out)


def _token_of(dims: int, sound):  # noqa: ANN001, ANN202
    return lambda t: t.isNotNull() & (F.size(t) == dims) & sound(t)


def _write_once(spark: SparkSession, root: str, name: str, text: str) -> None:
    """A small file that only one writer can make: written aside, then renamed to a name that must be free."""
    fs, target = hadoop_path(spark, f"{root}/{name}")
    _, aside = hadoop_path(spark, f"{root}/versions/.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(text.encode())
    out.close()
    sc = spark.sparkContext
    files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
    how = sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(fs.makeQualified(aside), fs.makeQualified(target), how)
    except Py4JJavaError as e:
        fs.delete(aside, False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            raise Conflict(name) from e
        raise


def _signs(seed: int):  # noqa: ANN202
    return lambda x, i: F.when(F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(2)) == 0, x).otherwise(-x)


def locality(vector: str):  # noqa: ANN201
    """A key under which near vectors stand together: the signs of 16 fixed projections, then the
    length's magnitude."""
    v = F.col(vector).cast("array<double>")
    bits = []
    for p in range(16):
        signed = F.transform(v, _signs(p))
        s = F.aggregate(signed, F.lit(0.0), lambda a, b: a + b)
        bits.append(F.when(s > 0, 1 << p).otherwise(0))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.coalesce(sum(bits, F.lit(0)) * 64 + F.least(F.lit(63), F.greatest(F.lit(0), F.floor(F.log2(norm + 1e-9)) + 32)), F.lit(-1))
