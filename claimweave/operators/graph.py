"""Public graph projection: verified, compatible, source-backed relations, their filters and views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..ontology import ORG8
from ..written import written


@dataclass(frozen=True)
class Filters:
    """Conjunctive filters of the graph; None does not filter."""

    predicate: str | None = None
    connection_class: str | None = None
    historical: bool | None = None
    date_from: str | None = None
    date_to: str | None = None
    entity_id: str | None = None
    entity_type: str | None = None
    topic: str | None = None
    person: str | None = None
    organisation: str | None = None


def evidence_full(evidence: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence that resolves to a document and its source, with the columns that the public may see."""
    d = documents.select(F.col("id").alias("document_id"), "source_id", F.coalesce("canonical_url", "original_url").alias("url"), "publisher")
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "source_quality")
    # Sources meet the documents, which are fewer than evidence.
    return evidence.select(F.col("id").alias("evidence_id"), "claim_id", "document_id", "evidence_text").join(sent(d.join(s, "source_id"), documents), "document_id")


#: Rows of a few short columns up to which a table is sent to every task; larger ones meet in a shuffle.
SENT = 1_000_000


def sent(df: DataFrame, of: DataFrame) -> DataFrame:
    """``df`` marked for a broadcast, if ``of``, which it has at most a row for each row of, is counted and small."""
    return F.broadcast(df) if of.count() <= SENT else df


def _selected(side: str, token: str, types: tuple[str, ...]) -> Column:
    token = token.strip().lower()
    return F.col(f"{side}_type").isin(*types) & (F.lower(f"{side}_id").eqNullSafe(token) | F.lower(f"{side}_slug").eqNullSafe(token) | F.lower(f"{side}_name").eqNullSafe(token))


def publishable(claims: DataFrame, entities: DataFrame, compatible: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Verified claims with an object and compatible types, joined with both entities, under ``filters``.

    A date filter leaves undated claims out; a claim with one date counts as that day.  A topic is a string leaf of the claim's notes or of
    either entity's metadata (JSON objects), at any depth.
    """
    c = claims.where((F.col("status") == "VERIFIED") & F.col("object_id").isNotNull())
    if filters.predicate:
        c = c.where(F.col("predicate") == filters.predicate)
    if filters.connection_class:
        c = c.where(F.col("connection_class") == filters.connection_class)
    if filters.historical is False:
        c = c.where(F.col("connection_class") != "HISTORICAL")
    if filters.date_from or filters.date_to:
        c = c.where(F.col("valid_from").isNotNull() | F.col("valid_to").isNotNull())
        if filters.date_to:
            c = c.where(F.coalesce("valid_from", "valid_to") <= F.lit(filters.date_to).cast("date"))
        if filters.date_from:
            c = c.where(F.coalesce("valid_to", "valid_from") >= F.lit(filters.date_from).cast("date"))
    if filters.entity_id:
        c = c.where((F.col("subject_id") == filters.entity_id) | (F.col("object_id") == filters.entity_id))
    for side in ("subject", "object"):
        e = entities.select(F.col("id").alias(f"{side}_id"), F.col("entity_type").alias(f"{side}_type"), F.col("canonical_name").alias(f"{side}_name"), F.col("slug").alias(f"{side}_slug"), F.col("canton").alias(f"{side}_canton"))
        c = c.join(e, f"{side}_id")
    if filters.entity_type:
        c = c.where((F.col("subject_type") == filters.entity_type) | (F.col("object_type") == filters.entity_type))
    if filters.topic is not None:
        noted = with_leaf(c.select("id", F.col("notes").alias("text")), filters.topic).withColumn("noted", F.lit(True))
        about = with_leaf(entities.select("id", F.col("metadata").alias("text")), filters.topic)
        c = c.join(noted, "id", "left")
        for side in ("subject", "object"):
            c = c.join(about.select(F.col("id").alias(f"{side}_id"), F.lit(True).alias(f"{side}_about")), f"{side}_id", "left")
        c = c.where(F.coalesce("noted", "subject_about", "object_about", F.lit(False))).drop("noted", "subject_about", "object_about")
    if filters.person:
        c = c.where(_selected("subject", filters.person, ("PERSON",)) | _selected("object", filters.person, ("PERSON",)))
    if filters.organisation:
        c = c.where(_selected("subject", filters.organisation, ORG8) | _selected("object", filters.organisation, ORG8))
    return c.join(F.broadcast(compatible), ["predicate", "subject_type", "object_type"], "left_semi")


def edges(claims: DataFrame, entities: DataFrame, evidence: DataFrame, compatible: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Edges with their evidence: number, qualities, and the primary one, which is the first with a source's name, url and text.

    ``evidence`` comes from ``evidence_full``.  It is aggregated for each claim and meets the claims that pass the filters after that, so
    that these are joined with their entities once.
    """
    shown = publishable(claims, entities, compatible, filters)
    usable = (F.col("source_name") != "") & (F.col("url") != "") & (F.col("evidence_text") != "")
    primary = F.struct(F.col("evidence_id").alias("id"), "url", "source_name", "publisher", "evidence_text")
    of_claim = evidence.withColumnRenamed("claim_id", "id").groupBy("id").agg(
        F.count(F.lit(1)).alias("n_evidence"),
        F.array_join(F.sort_array(F.collect_set("source_quality")), ",").alias("qualities"),
        F.array_join(F.sort_array(F.collect_list("evidence_id")), ",").alias("evidence_ids"),
        F.min(F.when(usable, primary)).alias("primary"),
    )
    return shown.join(of_claim, "id").select("*", "primary.url", "primary.source_name", "primary.publisher", "primary.evidence_text").drop("primary")


def nested(edge: DataFrame, evidence: DataFrame) -> DataFrame:
    """Edges as the API shows them: evidence as an array of structs with document and source inside, times in ISO form."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    told = evidence.select(F.col("claim_id").alias("id"), F.struct(
        F.col("evidence_id").alias("id"), F.col("evidence_text").alias("evidenceText"),
        F.struct(F.col("document_id").alias("id"), "url", "publisher", iso("published_at").alias("publishedAt") if "published_at" in evidence.columns else F.lit(None).cast("string").alias("publishedAt")).alias("document"),
        F.struct(F.col("source_id").alias("id"), F.col("source_name").alias("name"), F.col("source_quality").alias("sourceQuality")).alias("source"),
    ).alias("e"))
    lists = told.join(edge.select("id"), "id", "left_semi").groupBy("id").agg(F.sort_array(F.collect_list("e")).alias("evidence"))
    return edge.join(lists, "id").select("id", F.col("subject_id").alias("subjectEntityId"), "predicate", F.col("object_id").alias("objectEntityId"), F.col("connection_class").alias("connectionClass"), F.col("valid_from").cast("string").alias("validFrom"), F.col("valid_to").cast("string").alias("validTo"), "evidence")


def endpoints(edge: DataFrame) -> DataFrame:
    """(entity_id, other_id, id of the edge): both directions, so that an OR of endpoints is an equi-join."""
    return edge.select("id", F.explode(F.array(F.struct(F.col("subject_id").alias("entity_id"), F.col("object_id").alias("other_id")), F.struct(F.col("object_id").alias("entity_id"), F.col("subject_id").alias("other_id")))).alias("p")).select("id", "p.*")


def nodes(edge: DataFrame, entities: DataFrame) -> DataFrame:
    """The entities of surviving edges, with what the public may see of them; isolated ones never show."""
    return entities.join(endpoints(edge).select(F.col("entity_id").alias("id")).distinct(), "id", "left_semi").select("id", "entity_type", "canonical_name", "slug", "description", F.col("country").alias("country_code"))


def degrees(edge: DataFrame) -> DataFrame:
    return endpoints(edge).groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree"), F.countDistinct("other_id").alias("neighbours"))


def neighbours(edge: DataFrame) -> DataFrame:
    return endpoints(edge).select("entity_id", "other_id").distinct()


def timeline(edge: DataFrame, entities: DataFrame, undated_last: bool = False) -> DataFrame:
    """Each entity's edges in time; undated ones first (detail view) or last (research view).

    Names come with the edges, where they have them, else from ``entities``.
    """
    if not {"subject_name", "object_name"} <= set(edge.columns):
        for side in ("subject", "object"):
            edge = edge.join(entities.select(F.col("id").alias(f"{side}_id"), F.col("canonical_name").alias(f"{side}_name")), f"{side}_id")
    end = lambda own, other: F.struct(F.col(f"{own}_id").alias("entity_id"), F.col(f"{other}_name").alias("other_name"))
    day = F.coalesce("valid_from", "valid_to").cast("string").alias("day")
    dated = edge.select("id", "predicate", day, F.explode(F.array(end("subject", "object"), end("object", "subject"))).alias("p")).select("id", "predicate", "day", "p.*")
    key = F.coalesce("day", F.lit("Undated" if undated_last else ""))
    order = Window.partitionBy("entity_id").orderBy(key, "other_name", "id")
    label = F.initcap(F.replace(F.lower("predicate"), F.lit("_"), F.lit(" ")))
    return dated.select("entity_id", "id", F.col("other_name"), label.alias("label"), key.alias("day"), F.row_number().over(order).alias("position"))


#: Fields that the free-text search looks into: of the edge, and of its primary evidence.
SEARCHED = ("subject_name", "object_name", "predicate", "connection_class", "source_name", "publisher", "evidence_text")


def search(edge: DataFrame, text: str) -> DataFrame:
    """Edges with ``text`` in one of the SEARCHED fields, whatever its case; blank text keeps all."""
    q = text.strip().lower()
    hit = F.lit(not q)
    for f in SEARCHED:
        hit = hit | F.coalesce(F.contains(F.lower(f), F.lit(q)), F.lit(False))
    return edge.where(hit)


#: What a table of edges may be sorted by; ties go by id.
SORT_KEYS = {
    "person": "subject_name", "predicate": "predicate", "object": "object_name", "connectionClass": "connection_class",
    "validFrom": "coalesce(CAST(valid_from AS STRING), CAST(valid_to AS STRING), '')", "source": "coalesce(source_name, '')",
}


def sorted_edges(edge: DataFrame, keys: tuple[str, ...] = tuple(SORT_KEYS)) -> DataFrame:
    """(sort_key, id, position from 1) of each edge under each of ``keys``, from one range-partitioned pass."""
    values = F.array(*[F.struct(F.lit(k).alias("sort_key"), F.expr(SORT_KEYS[k]).alias("value")) for k in keys])
    placed = positions(edge.select("id", F.explode(values).alias("v")).select("v.*", "id"), ["sort_key", "value", "id"])
    first = placed.groupBy("sort_key").agg(F.min("position").alias("first"))
    return placed.join(F.broadcast(first), "sort_key").select("sort_key", "id", (F.col("position") - F.col("first") + 1).alias("position"))  # a row for each of six keys


def may_hold(text: str, wanted: str) -> Column:
    """Whether a JSON text can have the string ``wanted`` (lower case) as a value: in quotes that no colon follows, or written with escapes."""
    escaped, quoted = F.contains(text, F.lit("\\")), F.lit(f'"{wanted}"')
    return escaped if "\\" in wanted else escaped | (F.contains(F.lower(text), quoted) & F.rlike(F.lower(text), F.concat(F.lit("\\Q"), quoted, F.lit(r"\E[ \t\r\n]*(?:[^ \t\r\n:]|$)"))))


def with_leaf(texts: DataFrame, token: str) -> DataFrame:
    """(id) of ``texts`` (id, text; JSON objects) with a string leaf that equals ``token`` in any case; keys do not count, and what is no object has none.

    Values are exploded level by level, each level written, so that nesting has no bound.  Texts without the token as a string that is no key
    never start, unless they have escapes; what starts is parsed once.
    """
    wanted = token.strip().lower()
    spark = texts.sparkSession
    level = texts.where(F.lit(bool(wanted)) & may_hold("text", wanted) & F.rlike("text", F.lit(r"^[ \t\r\n]*\{"))).select("id", F.expr("try_parse_json(text)").alias("value"))
    found = texts.select("id").limit(0)
    while True:
        # A value's JSON text tells its kind by the first character.
        inner = written(spark.sql("SELECT id, e.value, left(to_json(e.value), 1) AS kind FROM {level}, LATERAL variant_explode(value) e", level=level).where(F.col("kind").isin('"', "{", "[")))
        found = found.unionByName(inner.where((F.col("kind") == '"') & (F.lower(F.expr("variant_get(value, '$', 'string')")) == wanted)).select("id"))
        level = inner.where(F.col("kind") != '"').select("id", "value")
        if level.isEmpty():
            return found.distinct()


def clusters(node: DataFrame) -> DataFrame:
    return node.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


def layout(node: DataFrame, radius: float = 100.0) -> DataFrame:
    """Polar places inside each type's cluster: ranks from a range-partitioned pass, since one type may hold most nodes."""
    placed = positions(node.select("entity_type", "id"), ["entity_type", "id"])
    kinds = placed.groupBy("entity_type").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n"))  # a row for each type
    index = F.col("position") - F.col("first")
    angle = 2 * F.pi() * index / F.col("n")
    return placed.join(F.broadcast(kinds), "entity_type").select("id", "entity_type", index.alias("index"), (F.round(radius * F.cos(angle), 6) + 0.0).alias("x"), (F.round(radius * F.sin(angle), 6) + 0.0).alias("y"))


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with each row's position (from 1) by ``order``, which tells rows apart and has no nulls.

    Rows are range-partitioned and written with the number of their range; a row's position is its rank in its range
    after the rows of the ranges before.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))
    counts = ranged.groupBy("__range").count()  # a row for each of ``parts``
    before = counts.select("__range", F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranked = ranged.withColumn("__rank", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    return ranked.join(F.broadcast(before), "__range").select(*df.columns, (F.col("__before") + F.col("__rank")).cast("int").alias("position"))
