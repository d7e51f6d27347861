"""Driver tables as journals of claims: one deterministic selection each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from factweave.functions import identifiers as ids

#: The time at which the queries over the events journal look: near the end of its days.
NOW = 1_706_500_000
#: The scope of chains of ids.
CHAIN = "u:chain/p:events"
_PROVENANCE = {"signup": "user_stated", "purchase": "observed", "error": "observed", "view": "inferred", "click": "inferred"}
_RELATION = {"purchase": "uses", "error": "rejects", "click": "contains", "signup": "describes", "view": "relates_to"}
_TTL = {"purchase": "permanent", "click": "weeks", "view": "session", "error": "permanent", "signup": "permanent"}


def _by(column: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def events_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the journal's fields; prev is the same user's event before."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    seq = F.col("event_id") + 1
    e = e.select(
        seq.alias("seq"), "user_id", "event_type", "k",
        F.concat(F.lit("u:"), (F.col("user_id") % 4).cast("string"), F.lit("/p:events")).alias("scope_key"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("created_at"),
        _by(F.col("event_type"), _RELATION).alias("relation"), _by(F.col("event_type"), _PROVENANCE).alias("provenance"), _by(F.col("event_type"), _TTL).alias("ttl"),
    ).withColumn("plain", (F.col("seq") % 301 != 5) & (F.col("seq") % 97 != 0) & (F.col("seq") % 50 != 7))
    own = Window.partitionBy("user_id").orderBy("seq")
    return e.withColumn("prev", F.when(F.lag("plain").over(own), F.lag("seq").over(own)))


def events_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-events: a statement for each event; some are retractions or reinterpretations of the same user's event before."""
    e = events_base(spark, sf_dir)
    root = e.select(F.col("seq").alias("prev"), *(F.col(c).alias(f"p_{c}") for c in ("event_type", "k", "provenance", "ttl")))
    e = e.join(root, "prev", "left")
    literal, label = F.col("relation") == "describes", F.when(F.col("relation") == "relates_to", F.lit("viewed"))
    kind = F.when((F.col("seq") % 301 == 5) & F.col("prev").isNotNull(), "event_retraction").when((F.col("seq") % 97 == 0) & F.col("prev").isNotNull(), "claim_retraction").otherwise("statement")
    over = (F.col("seq") % 50 == 7) & F.col("prev").isNotNull()
    e = e.withColumn("what", kind).withColumn("over", over)
    own = lambda c: F.when(F.col("over"), F.col(f"p_{c}")).otherwise(F.col(c))  # noqa: E731  a reinterpretation keeps its root's content
    text = F.concat(own("event_type"), F.lit(" user "), F.col("user_id").cast("string"), F.lit(" item "), own("k"))
    draft = F.struct(
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("subject"), F.lit("person").alias("subject_kind"), "relation", label.alias("relation_label"),
        F.when(~literal, F.concat(F.lit("item "), F.col("k"))).alias("object"), F.when(~literal, F.lit("thing")).alias("object_kind"),
        F.when(literal, F.concat(F.lit("tier "), (F.col("seq") % 3).cast("string"))).alias("object_value"),
    )
    statement = F.to_json(F.struct(text.alias("raw_text"), F.array(draft).alias("parsed"), own("provenance").alias("provenance"), own("ttl").alias("ttl"), F.when(F.col("over"), ids.event_id(F.col("prev"))).alias("supersedes")))
    retraction = F.to_json(F.struct(F.struct(ids.event_id(F.col("prev")).alias("event_id"), (F.col("seq") % 2 == 0).alias("cascade")).alias("target")))
    claim = F.to_json(F.struct(F.struct(F.concat(F.lit("c"), F.col("prev").cast("string"), F.lit(".0")).alias("claim_id")).alias("target")))
    body = F.when(F.col("what") == "statement", statement).when(F.col("what") == "event_retraction", retraction).otherwise(claim)
    null = F.lit(None).cast("string")
    return e.select("seq", ids.event_id(F.col("seq")).alias("id"), "scope_key", F.when(F.col("what") == "statement", "statement").otherwise("retraction").alias("kind"), body.alias("body"), null.alias("actor"), null.alias("branch"), null.alias("session"), "created_at")


def decided_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-decided: every event is a statement of one or two drafts; then users are merged in pairs (u and u + 4), some get an alias, and a statement uses it."""
    e = events_base(spark, sf_dir).select("seq", "user_id", "k", "scope_key", "created_at", "relation")
    literal = F.col("relation") == "describes"
    user, item = F.concat(F.lit("user "), F.col("user_id").cast("string")), F.concat(F.lit("item "), F.col("k"))
    null = F.lit(None).cast("string")

    def draft(subject, relation, label, object_, value):
        return F.struct(subject.alias("subject"), relation.alias("relation"), label.alias("relation_label"), object_.alias("object"), value.alias("object_value"))

    own = draft(user, F.col("relation"), F.when(F.col("relation") == "relates_to", F.concat(F.lit("viewed "), (F.col("seq") % 4).cast("string"))), F.when(~literal, item), F.when(literal, F.concat(F.lit("tier "), (F.col("seq") % 3).cast("string"))))
    back = draft(item, F.lit("relates_to"), F.concat(F.lit("by "), (F.col("seq") % 5).cast("string")), user, null)
    parsed = F.when(~literal & (F.col("seq") % 3 == 0), F.array(own, back)).otherwise(F.array(own))

    def says(drafts):
        return F.to_json(F.struct(F.lit("said").alias("raw_text"), drafts.alias("parsed"), F.lit("observed").alias("provenance"), F.lit("permanent").alias("ttl")))

    users = e.groupBy("user_id", "scope_key").agg(F.min("seq").alias("first"), F.min_by("k", "seq").alias("k"))
    entity = ids.make("e", F.col("first"), F.lit(0))
    other = users.select((F.col("user_id") - 4).alias("user_id"), F.col("first").alias("other"))
    kept = users.where("user_id % 8 < 4")
    merges = kept.join(other, "user_id").select("scope_key", F.lit("merge").alias("kind"), F.lit(0).alias("part"), "user_id", F.to_json(F.struct(entity.alias("keep"), ids.make("e", F.col("other"), F.lit(0)).alias("absorb"))).alias("body"))
    named = kept.where("user_id % 3 = 0")
    called = F.concat(F.lit("al "), user)
    aliases = named.select("scope_key", F.lit("alias").alias("kind"), F.lit(1).alias("part"), "user_id", F.to_json(F.struct(called.alias("surface"), entity.alias("entity_id"))).alias("body"))
    later = named.select("scope_key", F.lit("statement").alias("kind"), F.lit(2).alias("part"), "user_id", says(F.array(draft(called, F.lit("uses"), null, item, null))).alias("body"))
    added = merges.unionByName(aliases).unionByName(later)
    # places among the added events, whose number is that of users: counted by part and user over slices of users, then within a slice
    slice_ = F.floor(F.col("user_id") / 1024)
    cells = added.groupBy("part", slice_.alias("slice")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part", "slice").rowsBetween(Window.unboundedPreceding, -1)  # a row for 1024 users
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part", "slice").orderBy("user_id"))
    added = added.withColumn("slice", slice_).withColumn("nth", place).join(cells, ["part", "slice"])
    added = added.select((e.agg(F.max("seq")).scalar() + F.col("before") + F.col("nth")).alias("seq"), "scope_key", "kind", "body", e.agg(F.max("created_at")).scalar().alias("created_at"))
    all_ = e.select("seq", "scope_key", F.lit("statement").alias("kind"), says(parsed).alias("body"), "created_at").unionByName(added)
    return all_.select("seq", ids.event_id(F.col("seq")).alias("id"), "scope_key", "kind", "body", null.alias("actor"), null.alias("branch"), null.alias("session"), "created_at")


def star_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, relation, object, n) of the star tables: regions contain nations, nations contain suppliers, and customers use or reject brands."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nation, region, supplier, customer, part = map(read, ("nation", "region", "supplier", "customer", "part"))
    a = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("subject"), F.lit("contains").alias("relation"), F.col("n_name").alias("object"))
    b = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", F.lit("contains"), "s_name")
    line = read("lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    orders = read("orders").select("o_orderkey", "o_custkey")
    used = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    c = used.select("n_name", F.when(F.col("l_returnflag") == "R", "rejects").otherwise("uses"), "p_brand")
    return a.union(b).union(c).groupBy("subject", "relation", "object").agg(F.count("*").alias("n"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-text: documents as raw statements without drafts: (seq, scope_key, raw_text)."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select((F.col("doc_id") + 1).alias("seq"), F.concat(F.lit("u:docs/p:"), F.col("lang")).alias("scope_key"), F.col("text").alias("raw_text"))
