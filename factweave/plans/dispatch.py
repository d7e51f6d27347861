"""Writing: append, choice between ways to project, projection of the scopes concerned, atomic publication."""

from __future__ import annotations

import json
import secrets
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from factweave import constants as K, schema
from factweave.operators import checks, incremental, lookup, parts, prescan, projection
from factweave.operators.prescan import Refused
from factweave.operators.projection import Projection
from factweave.scratch import materialize, scratch


def project(journal: DataFrame) -> Projection:
    """Each scope the cheapest way that is right for it: set-based, or by the fold where its decisions make the rules depend on order. What one way refuses, the other refuses too."""
    steps = projection.prepared(journal)
    ordered = materialize(projection.ordered_scopes(steps), "ordered")
    if ordered.isEmpty():
        return projection.project_prepared(steps)
    a = projection.project_prepared(steps.only(ordered, "left_anti"))
    b = parts.project_prepared(steps.only(ordered, "left_semi"))
    return Projection(**{k: t.select(*schema.TABLES[k].names).unionByName(b.tables()[k].select(*schema.TABLES[k].names)) for k, t in a.tables().items()})


def mode(events: DataFrame) -> DataFrame:
    """(scope_key, mode, reason) for new events: reinterpretations and event retractions need a replay."""
    e = prescan.parsed(events)
    flags = e.groupBy("scope_key").agg(F.max(F.col("b.supersedes").isNotNull().cast("int")).alias("over"), F.max(F.col("b.target.event_id").isNotNull().cast("int")).alias("undo"))
    reason = F.when(F.col("over") == 1, "supersedes").when(F.col("undo") == 1, "event_retraction").otherwise("append_only")
    return flags.select("scope_key", F.when(reason == "append_only", "incremental").otherwise("replay").alias("mode"), reason.alias("reason"))


def replay_reasons(journal: DataFrame, meta: DataFrame, invalid: DataFrame, rules_version: int = K.RULES_VERSION) -> DataFrame:
    """(scope_key, reason or null): whether the stored projection of a scope must be made anew; the first reason that holds."""
    last = journal.groupBy("scope_key").agg(F.max("seq").alias("seq"))
    bad = invalid.select("scope_key").distinct().withColumn("bad", F.lit(True))
    j = last.join(meta, "scope_key", "full_outer").join(bad, "scope_key", "left")
    reason = F.when(F.col("last_seq").isNull(), "missing_meta").when(F.col("rules_version") != rules_version, "rules_version_changed").when(~F.col("last_seq").eqNullSafe(F.col("seq")), "journal_sequence_changed").when(F.col("bad"), "projection_invariant_failed")
    return j.select("scope_key", reason.alias("reason"))


#: Random characters of an event id, after those of the time.
_ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
RETRIES = 5
#: Journal folders that a version lists at most; with more, they are written into one.
FOLDERS = 100


class Conflict(RuntimeError):
    """Another writer has published a version since this one was read; nothing of the write shows."""


def event_ids(now: int, n: int) -> list[str]:
    """n new ids: the time in milliseconds, then 80 random bits."""

    def coded(value: int, size: int) -> str:
        return "".join(_ALPHABET[value >> 5 * i & 31] for i in reversed(range(size)))

    return ["ev_" + coded(now * 1000 % (1 << 48), 10) + coded(secrets.randbits(80), 16) for _ in range(n)]


@dataclass(frozen=True)
class Version:
    """What a manifest names: the journal's folders, the folder of the table of scopes, the last seq, and the last epoch of a stream."""

    number: int = 0
    journal: tuple[str, ...] = ()
    scopes: str | None = None
    last_seq: int = 0
    epoch: int = -1


@dataclass(frozen=True)
class Store:
    """A journal and projections under one path.

    A write adds its events as a journal folder of its own and the tables of the
    scopes that it touches as folders of their own; all else stays where it is. A
    table of scopes says in which folder each scope's rows are. The manifest of
    the new version is renamed into place last, which fails if another writer was
    first: so a version appears as a whole or not at all, all six tables at once,
    and a reader that has taken a version keeps seeing it.
    """

    spark: SparkSession
    path: str
    version: Version = Version()

    # --- manifests

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> Store:
        """The version that readers see now."""
        jvm, root, fs = self._files()
        names = [s.getPath() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "manifest-*")) or []]
        if not names:
            return replace(self, version=Version())
        newest = max(names, key=lambda p: int(p.getName().removeprefix("manifest-")))
        stream = fs.open(newest)
        try:
            found = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return replace(self, version=Version(**{**found, "journal": tuple(found["journal"])}))

    def publish(self, version: Version) -> Store:
        """Make a version the current one, unless another has its number."""
        jvm, root, fs = self._files()
        path = lambda name: jvm.org.apache.hadoop.fs.Path(root, name)
        own, target = path(f"_manifest-{uuid.uuid4().hex}"), path(f"manifest-{version.number}")
        out = fs.create(own, False)
        out.write(bytearray(json.dumps(asdict(version)).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri()).rename(own, target, options)
        except Exception as e:
            fs.delete(own, False)
            if fs.exists(target):
                raise Conflict(target.getName()) from e
            raise
        return replace(self, version=version)

    # --- reading

    def _read(self, folders: list[str], s, base: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], s)
        return self.spark.read.schema(s).option("basePath", f"{self.path}/{base}").parquet(*(f"{self.path}/{base}/folder={f}" for f in folders))

    def journal(self) -> DataFrame:
        return self._read(list(self.version.journal), schema.JOURNAL, "journal").select(*schema.JOURNAL.names)

    def scopes(self) -> DataFrame:
        """(scope_key, folder, last_seq, rules_version, rebuilt_at) of all scopes."""
        if self.version.scopes is None:
            return self.spark.createDataFrame([], schema.SCOPES)
        return self.spark.read.schema(schema.SCOPES).parquet(f"{self.path}/scopes/{self.version.scopes}")

    def table(self, name: str) -> DataFrame:
        """A table of this version: journal, meta, or one of the six. Scopes and folders are directories, so a filter by scope reads only its own."""
        if name == "journal":
            return self.journal()
        if name == "meta":
            return self.scopes().select(*schema.META.names)
        s = schema.TABLES[name]
        jvm, root, fs = self._files()
        if self.version.scopes is None or not fs.exists(jvm.org.apache.hadoop.fs.Path(root, name)):
            return self.spark.createDataFrame([], s)
        rows = self.spark.read.schema(T.StructType([*s.fields, T.StructField("folder", T.StringType())])).parquet(f"{self.path}/{name}")
        return rows.join(self.scopes().select("scope_key", "folder"), ["scope_key", "folder"], "left_semi").select(*schema.TABLES[name].names)

    def projection(self) -> Projection:
        return Projection(**{n: self.table(n) for n in schema.TABLES})

    def index(self) -> tuple[DataFrame, DataFrame]:
        """(postings, measured) of all statements, for phrase search."""
        folders = list(self.version.journal)
        return self._read(folders, schema.POSTINGS, "postings").select(*schema.POSTINGS.names), self._read(folders, schema.MEASURED, "measured").select(*schema.MEASURED.names)

    # --- writing

    def _projected(self, touched: DataFrame, own: DataFrame, folder: str) -> Projection:
        """The touched scopes after the events of a journal folder: grown from this version where the events only add, else replayed from their whole journals."""
        added = materialize(self._read([folder], schema.JOURNAL, "journal").select(*schema.JOURNAL.names), "added")
        before = Projection(**{n: materialize(t.join(touched, "scope_key", "left_semi").select(*schema.TABLES[n].names), n) for n, t in self.projection().tables().items()})
        if self.version.number and incremental.replayed_scopes(before, added).isEmpty():
            return incremental.advance(before, own.join(added.select("id"), "id", "left_anti"), added)
        return project(own)

    def written(self, new: DataFrame, now: int, last_seq: int, epoch: int = -1) -> Store:
        """The next version: the new events, and the projection of the scopes that they touch. Refused or conflicting writes show nothing; steps on the way are freed."""
        with scratch():
            return self._written(new, now, last_seq, epoch)

    def _written(self, new: DataFrame, now: int, last_seq: int, epoch: int) -> Store:
        folder, v = uuid.uuid4().hex, self.version
        journal = [*v.journal, folder]
        new.select(*schema.JOURNAL.names).write.partitionBy("scope_key").parquet(f"{self.path}/journal/folder={folder}")
        # from the files: what is projected is what was stored
        full = replace(self, version=replace(v, journal=tuple(journal))).journal()
        touched = materialize(self._read([folder], schema.JOURNAL, "journal").select("scope_key").distinct(), "touched")
        own = materialize(full.join(touched, "scope_key", "left_semi"), "own")
        if bad := prescan.body_violations(own).take(1):
            raise Refused(bad[0]["problem"])
        for name, t in self._projected(touched, own, folder).tables().items():
            t.select(*schema.TABLES[name].names).write.partitionBy("scope_key").parquet(f"{self.path}/{name}/folder={folder}")
        # texts never change, so the search index only grows by the new ones; in order of trigrams, so that a search reads few row groups
        raw = prescan.parsed(self._read([folder], schema.JOURNAL, "journal").where("kind = 'statement'")).select("scope_key", "seq", F.col("b.raw_text").alias("raw_text"))
        lookup.postings(raw).sort("trigram").write.parquet(f"{self.path}/postings/folder={folder}")
        lookup.measured(raw).write.parquet(f"{self.path}/measured/folder={folder}")
        last = own.groupBy("scope_key").agg(F.max("seq").alias("last_seq"))
        mine = last.select("scope_key", F.lit(folder).alias("folder"), "last_seq", F.lit(K.RULES_VERSION).alias("rules_version"), F.lit(now).cast("long").alias("rebuilt_at"))
        replaced(self.scopes(), mine, touched).write.parquet(f"{self.path}/scopes/{folder}")
        if len(journal) > FOLDERS:
            packed = uuid.uuid4().hex
            full.write.partitionBy("scope_key").parquet(f"{self.path}/journal/folder={packed}")
            posted, measured = replace(self, version=replace(v, journal=tuple(journal))).index()
            posted.sort("trigram").write.parquet(f"{self.path}/postings/folder={packed}")
            measured.groupBy("scope_key").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).write.parquet(f"{self.path}/measured/folder={packed}")
            journal = [packed]
        return self.publish(Version(v.number + 1, tuple(journal), folder, last_seq, epoch if epoch >= 0 else v.epoch))


def replaced(old: DataFrame, new: DataFrame, scopes: DataFrame) -> DataFrame:
    """A table in which the rows of some scopes are new: delete and insert as one expression."""
    return old.join(scopes, "scope_key", "left_anti").unionByName(new)


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): what an upsert would insert, update or remove; unchanged rows are left out. Statements, entities, claims and redirects may not be removed."""
    value = lambda df, name: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    both = value(old, "old").join(value(new, "new"), keys, "full_outer")
    change = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "remove").when(~F.col("old").eqNullSafe(F.col("new")), "update")
    return both.select(*keys, change.alias("change")).where("change is not null")


def submit(store: Store, request: dict, now: int) -> dict:
    """execute() for requests from outside: {'events': [{scope_key, kind, body}, ...]}. What would write tables without events is refused."""
    if set(request) - {"events"}:
        raise ValueError("PROJECTION_ONLY_WRITE" if "events" not in request else "UNKNOWN_REQUEST")
    return execute(store, [(e["scope_key"], e["kind"], e["body"]) for e in request.get("events", [])], now)


def execute(store: Store, intents: list[tuple[str, str, dict]], now: int) -> dict:
    """Append (scope_key, kind, body) intents and publish the projection of their scopes; all or nothing.

    Ids are random; seq has no gaps and follows the order of the intents. A write
    that meets another one, or whose ids exist already, is tried again from the
    version that is current then, RETRIES times at most. The receipt is checked
    against what was stored.
    """
    if not intents:
        raise ValueError("EMPTY_BATCH")
    for _ in range(RETRIES):
        store = store.current()
        made = event_ids(now, len(intents))
        last = store.version.last_seq
        null = None
        rows = [(last + 1 + i, e, s, k, json.dumps(b, ensure_ascii=False), null, null, null, now) for i, (e, (s, k, b)) in enumerate(zip(made, intents))]
        new = store.spark.createDataFrame(rows, schema.JOURNAL)
        if len(set(made)) < len(made) or not store.journal().join(F.broadcast(new.select("id")), "id", "left_semi").isEmpty():  # one request's ids
            continue
        try:
            published = store.written(new, now, last + len(rows))
        except Conflict:
            continue
        receipt(published, rows)
        counts = {r["name"]: r["n"] for r in checks.row_counts(published.projection()).groupBy("name").agg(F.sum("n").alias("n")).collect()}
        return {"events": made, "rows": counts, "mode": {r["scope_key"]: r["mode"] for r in mode(new).collect()}, "last_seq": last + len(rows), "version": published.version.number}
    raise Conflict("RETRIES_EXHAUSTED")


def receipt(store: Store, rows: list[tuple]) -> None:
    """Stored events against those that were sent: as many, the same ids, each at its seq."""
    first, last = rows[0][0], rows[-1][0]
    stored = {(r["seq"], r["id"]) for r in store.journal().where(F.col("seq").between(first, last)).select("seq", "id").collect()}
    if len(stored) != len(rows):
        raise RuntimeError("RECEIPT_COUNT_MISMATCH")
    if {i for _, i in stored} != {r[1] for r in rows}:
        raise RuntimeError("RECEIPT_ID_MISMATCH")
    if stored != {(r[0], r[1]) for r in rows}:
        raise RuntimeError("RECEIPT_SEQ_MISMATCH")
