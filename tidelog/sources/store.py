"""Stores on Parquet: append-only operation logs, snapshots and a catalog of databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.codec import content_hash
from tidelog.operators import acl, documents, fold, log
from tidelog.operators.sync import accepted_store

OPS = T.StructType([
    T.StructField("hash", T.StringType()), T.StructField("log_id", T.StringType()), T.StructField("time", T.LongType()), T.StructField("clock_id", T.StringType()), T.StructField("next", T.ArrayType(T.StringType())),
    T.StructField("key", T.StringType()), T.StructField("op", T.StringType()), T.StructField("value", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("identity_id", T.StringType()), T.StructField("pub_key", T.StringType()),
    T.StructField("docs", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))),
])


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that Spark knows is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


class OpLogTable:
    """One append-only table of operations. Missing columns are filled with nulls, so any store can use it.

    Rows lie in folders by a hash of their key (of the entry's hash where there is no key), and in files by time: a look-up
    of a key reads one folder, and a range of time the row groups that overlap it.
    """

    def __init__(self, spark: SparkSession, path: str, folders: int = 16):
        self.spark, self.path, self.folders = spark, path, folders

    def _folder(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.folders)).cast("int")

    def _scan(self) -> DataFrame:
        schema = T.StructType([*OPS, T.StructField("folder", T.IntegerType())])
        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self._scan().drop("folder")

    def of_key(self, key: str) -> DataFrame:
        """The operations on one key."""
        return self._scan().where((F.col("folder") == self._folder(F.lit(key))) & (F.col("key") == key)).drop("folder")

    def append(self, ops: DataFrame) -> None:
        shaped = ops.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in ops.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in OPS))
        shaped.withColumn("folder", self._folder(F.coalesce("key", "hash"))).sortWithinPartitions("folder", "time").write.mode("append").partitionBy("folder").parquet(self.path)

    def compacted(self, path: str) -> OpLogTable:
        """A copy with each operation once and few files, for a log of many small appends. A folder may be many files, so
        that a hot one is not written by a single task."""
        new = OpLogTable(self.spark, path, self.folders)
        rows = self._scan().dropDuplicates(["hash"]).withColumn("folder", self._folder(F.coalesce("key", "hash")))
        rows.hint("rebalance", "folder").sortWithinPartitions("folder", "time").write.mode("overwrite").partitionBy("folder").parquet(path)
        return new

    def reset(self) -> None:
        self.spark.createDataFrame([], OPS).withColumn("folder", F.lit(0)).write.mode("overwrite").partitionBy("folder").parquet(self.path)


class _Store:
    """What all kinds of stores share: a log of operations by one writer."""

    kind = ""

    def __init__(self, table: OpLogTable, name: str, writer: str):
        self.table, self.name, self.writer = table, name, writer

    @property
    def spark(self) -> SparkSession:
        return self.table.spark

    def log(self) -> DataFrame:
        return self.table.read()

    def _write(self, rows: list[tuple[str | None, str, str | None, str | None]], docs: list[tuple[str, str]] | None = None) -> None:
        """Appends operations (key, op, value, payload), each after the one before. docs: the pairs of a PUTALL."""
        entries = self.log()
        time = log.clock_time(entries).first()["time"]
        new = self.spark.createDataFrame([(k + 1, *r, docs) for k, r in enumerate(rows)], "n long, key string, op string, value string, payload string, docs array<struct<key:string,value:string>>")
        timed = new.select(F.lit(self.name).alias("log_id"), (F.col("n") + time).alias("time"), F.lit(self.writer).alias("clock_id"), "key", "op", "value", "payload", "docs", "n")
        tops = log.heads(entries.where(F.size("next") >= 0)).agg(F.sort_array(F.collect_list("hash")).alias("heads_")).withColumn("n", F.lit(1).cast("long"))
        hashed = timed.withColumn("hash", content_hash("log_id", "time", "clock_id", "op", F.coalesce("key", F.lit("")), F.coalesce("value", "payload", F.to_json("docs"), F.lit(""))))
        before = F.array_compact(F.array(F.lag("hash").over(_by_n())))
        linked = hashed.withColumn("before_", before).join(F.broadcast(tops), "n", "left")
        self.table.append(linked.withColumn("next", F.when(F.col("n") == 1, F.col("heads_")).otherwise(F.col("before_"))))

    def sync(self, entries: DataFrame, grants: DataFrame | None = None) -> None:
        """Takes entries of another replica in; known ones are left out, and with grants those that they don't allow."""
        new = entries.dropDuplicates(["hash"])
        self.table.append(log.missing_from(new, self.log()) if grants is None else accepted_store(new, self.log(), grants))

    def state(self) -> DataFrame:
        """What a query on the store sees: the log, unless a kind of store says otherwise."""
        return self.log()

    def snapshot(self, path: str) -> None:
        """The log as a folder of its own, with a record of heads and size."""
        entries = self.log()
        entries.write.mode("overwrite").parquet(f"{path}/entries")
        log.heads(entries).agg(F.sort_array(F.collect_list("hash")).alias("heads"), F.lit(self.name).alias("id"), F.lit(self.kind).alias("type"), F.lit(entries.count()).alias("size")).write.mode("overwrite").parquet(f"{path}/header")

    def load_more(self, remote: DataFrame, heads: DataFrame, amount: int = -1) -> None:
        """Takes in what is reached from heads (a column hash) in a remote log, newest first, up to amount entries."""
        new = log.traverse(log.missing_from(remote, self.log()), heads, amount)
        self.sync(new)

    def drop(self) -> None:
        """Empties the store."""
        self.table.reset()

    def load(self, path: str) -> None:
        self.sync(self.spark.read.schema(OPS).parquet(f"{path}/entries"))


def _by_n():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("log_id").orderBy("n")


class EventLog(_Store):
    kind = "eventlog"

    def add(self, *payloads: str) -> None:
        if any(not x for x in payloads):
            raise ValueError("an entry needs a payload")
        self._write([(None, "ADD", None, x) for x in payloads])

    def list(self, **bounds: object) -> DataFrame:
        return log.list_store(self.log(), **bounds)

    def get(self, hash_: str) -> DataFrame:
        return log.require(log.get(self.log(), hash_), hash_)


class KeyValue(_Store):
    kind = "keyvalue"

    def put(self, key: str, value: str) -> None:
        self.put_all({key: value})

    def put_all(self, pairs: dict[str, str]) -> None:
        if not pairs or not all(pairs) or not all(pairs.values()):
            raise ValueError("a key and a value are needed")
        self._write([(key, "PUT", value, None) for key, value in pairs.items()])

    def delete(self, key: str) -> None:
        log.require(self.get(key), key)
        self._write([(key, "DEL", None, None)])

    def all(self) -> DataFrame:
        return fold.current(self.log())

    state = all

    def get(self, key: str) -> DataFrame:
        return fold.current(self.table.of_key(key))


class Documents(_Store):
    kind = "document"

    def __init__(self, table: OpLogTable, name: str, writer: str, key: str = "_id"):
        super().__init__(table, name, writer)
        self.key = key

    def _keyed(self, bodies: tuple[str, ...]) -> list[tuple[str, str]]:
        """The documents' keys and bodies; all keys are checked before anything is written."""
        import json

        if not bodies:
            raise ValueError("an empty batch")
        rows = []
        for body in bodies:
            found = json.loads(body)
            key = found.get(self.key) if isinstance(found, dict) else None
            if not isinstance(key, str) or not key:
                raise ValueError(f"the document needs a text under {self.key}")
            rows.append((key, body))
        return rows

    def put(self, *bodies: str) -> None:
        """An operation for each document."""
        self._write([(key, "PUT", body, None) for key, body in self._keyed(bodies)])

    put_batch = put

    def put_all(self, *bodies: str) -> None:
        """One operation for all documents."""
        self._write([(None, "PUTALL", None, None)], self._keyed(bodies))

    def delete(self, key: str) -> None:
        log.require(self.all().where(F.col("key") == key), key)
        self._write([(key, "DEL", None, None)])

    def all(self) -> DataFrame:
        return fold.document_state(self.log()).withColumnRenamed("value", "body")

    state = all

    def get(self, text: str, case_insensitive: bool = False, partial: bool = False) -> DataFrame:
        return documents.search(self.all(), text, case_insensitive, partial)

    def query(self, predicate) -> DataFrame:  # noqa: ANN001
        """Documents of which a Column, or a function of the parsed body, holds."""
        return documents.query_callable(self.all(), predicate) if callable(predicate) else documents.query(self.all(), predicate)


class AccessList(_Store):
    """Grants of roles to keys, as operations like any other; "*" stands for anyone."""

    kind = "access"

    def grant(self, role: str, *keys: str) -> None:
        found = [k for k in dict.fromkeys(keys) if k]
        if not role or not found:
            raise ValueError("a role and a key are needed")
        self._write([(f"{role}/{k}", "PUT", k, None) for k in found])

    def revoke(self, role: str, *keys: str) -> None:
        self._write([(f"{role}/{k}", "DEL", None, None) for k in keys])

    def grants(self) -> DataFrame:
        """role and key, as granted."""
        return fold.current(self.log()).select(F.regexp_extract("key", "^([^/]*)/", 1).alias("role"), F.col("value").alias("key"))

    def effective(self) -> DataFrame:
        """role and key, where writers are admins too."""
        return acl.effective(self.grants())

    state = effective


class Database:
    """A folder of stores. A store is made at its first use, and opened as the same kind after that."""

    scheme = "store"
    kinds: dict[str, type[_Store]] = {"eventlog": EventLog, "keyvalue": KeyValue, "document": Documents, "access": AccessList}

    def __init__(self, spark: SparkSession, path: str, writer: str = "local"):
        self.spark, self.path, self.writer = spark, path, writer

    @classmethod
    def register(cls, kind: str, make: type[_Store]) -> None:
        cls.kinds = cls.kinds | {kind: make}

    @classmethod
    def unregister(cls, kind: str) -> None:
        cls.kinds = {k: v for k, v in cls.kinds.items() if k != kind}

    def _catalog(self) -> DataFrame:
        if not _exists(self.spark, f"{self.path}/catalog"):
            return self.spark.createDataFrame([], "name string, type string, id string")
        return self.spark.read.schema("name string, type string, id string").option("recursiveFileLookup", "true").parquet(f"{self.path}/catalog")

    def _record(self, name: str) -> str:
        """The folder of a store's one row of the catalog."""
        import hashlib

        return f"{self.path}/catalog/{hashlib.sha256(name.encode()).hexdigest()}"

    def address(self, name: str) -> str:
        """The address of a store: the hash of its manifest, then its name."""
        found = self._catalog().where(F.col("name") == name).first()
        if found is None:
            raise LookupError(f"no store {name}")
        return f"/{self.scheme}/{found['id']}/{name}"

    def open_address(self, address: str) -> _Store:
        """The store of an address; an error if the address is of another manifest."""
        name = address.split("/", 3)[3] if address.count("/") >= 3 else ""
        if not name or self.address(name) != address:
            raise LookupError(f"no store at {address}")
        return self.open(name)

    def drop(self, name: str) -> None:
        """Empties a store and forgets it."""
        self.open(name).drop()
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._record(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def create(self, name: str, kind: str, overwrite: bool = False) -> _Store:
        if kind not in self.kinds:
            raise ValueError(f"unknown store type {kind}")
        if not overwrite and not self._catalog().where(F.col("name") == name).isEmpty():
            raise ValueError(f"{name} already exists")
        row = self.spark.createDataFrame([(name, kind)], "name string, type string").withColumn("id", content_hash(F.col("name"), F.col("type")))
        row.write.mode("overwrite").parquet(self._record(name))
        store = self.kinds[kind](OpLogTable(self.spark, f"{self.path}/stores/{name}"), name, self.writer)
        if overwrite:
            store.table.reset()
        return store

    def open(self, name: str, kind: str | None = None, create: bool = False) -> _Store:
        found = self._catalog().where(F.col("name") == name).select("type").first()
        if found is None:
            if not create or kind is None:
                raise LookupError(f"no store {name}")
            return self.create(name, kind)
        if kind is not None and kind != found["type"]:
            raise ValueError(f"{name} is of type {found['type']}")
        return self.kinds[found["type"]](OpLogTable(self.spark, f"{self.path}/stores/{name}"), name, self.writer)

    def stores(self) -> DataFrame:
        return self._catalog()

    def log(self, name: str) -> EventLog:
        return self.open(name, "eventlog", create=True)

    def key_value(self, name: str) -> KeyValue:
        return self.open(name, "keyvalue", create=True)

    def docs(self, name: str) -> Documents:
        return self.open(name, "document", create=True)

    def access(self, name: str) -> AccessList:
        return self.open(name, "access", create=True)

    def views(self, prefix: str = "") -> list[str]:
        """Makes every store's state a temporary view, so that SQL can query and join them; their names."""
        names = sorted(r["name"] for r in self.stores().collect())
        for name in names:
            self.open(name).state().createOrReplaceTempView(f"{prefix}{name}")
        return [f"{prefix}{name}" for name in names]
