"""Resolving mentions to entities and files, merging duplicates, and rules of entity relations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import char_places, extension, fold, indel_ratio, lcs_of_places, may_reach, stem
from ..functions.tables import settled
from .graph import name_keys
from .search import similar

#: Least name similarity (percent / 100) and least cosine by entity type.
THRESHOLDS = {"file": (0.95, 0.97), "technology": (0.85, 0.90), "concept": (0.75, 0.82), "pattern": (0.78, 0.85), "system": (0.88, 0.92), "person": (0.92, 0.95), "organization": (0.90, 0.93)}
OTHER_THRESHOLDS = (0.85, 0.90)
#: Fuzzy names are sought from the best ratios down: most mentions end before the lower ones, where grams tell little.
LEVELS = (90.0, 80.0)
#: Parts that the names of one class of lengths are dealt to.
CLASS_PARTS = 32
#: Languages by file extension.
LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".rs": "rust", ".go": "go", ".java": "java", ".kt": "kotlin", ".cs": "csharp", ".cpp": "cpp", ".c": "c", ".rb": "ruby",
    ".php": "php", ".swift": "swift", ".scala": "scala", ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".sql": "sql", ".toml": "toml", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".md": "markdown", ".mdx": "markdown",
}
#: Which (source, target) types of entities a relationship may join, most specific relationship first.
ALLOWED = {
    "REQUIRES": [("technology", "technology"), ("technology", "concept"), ("pattern", "technology"), ("pattern", "concept"), ("system", "technology"), ("system", "concept")],
    "DEPENDS_ON": [("technology", "technology"), ("system", "technology"), ("system", "system"), ("pattern", "technology"), ("pattern", "concept")],
    "ENABLES": [("technology", "concept"), ("technology", "pattern"), ("technology", "system"), ("pattern", "concept"), ("system", "concept"), ("system", "system"), ("concept", "concept")],
    "PREVENTS": [("technology", "concept"), ("pattern", "concept"), ("system", "concept"), ("concept", "concept")],
    "REFINES": [("technology", "technology"), ("pattern", "pattern"), ("concept", "concept"), ("system", "system")],
    "PART_OF": [("technology", "system"), ("technology", "technology"), ("technology", "concept"), ("system", "system"), ("pattern", "system"), ("concept", "concept"), ("person", "organization")],
    "IS_A": [("technology", "concept"), ("technology", "technology"), ("pattern", "concept"), ("system", "concept"), ("concept", "concept")],
    "ALTERNATIVE_TO": [("technology", "technology"), ("pattern", "pattern"), ("system", "system"), ("concept", "concept")],
    "RELATED_TO": [
        ("technology", "technology"),
        ("technology", "concept"),
        ("technology", "pattern"),
        ("technology", "system"),
        ("concept", "concept"),
        ("concept", "pattern"),
        ("concept", "system"),
        ("pattern", "pattern"),
        ("pattern", "system"),
        ("system", "system"),
        ("person", "technology"),
        ("person", "system"),
        ("organization", "technology"),
        ("organization", "system"),
    ],
}
DECISION_RELS = ["SIMILAR_TO", "INFLUENCED_BY", "SUPERSEDES", "CONTRADICTS"]


def allowed_relations(spark) -> DataFrame:
    rows = [(rel, source, target, i) for i, (rel, pairs) in enumerate(ALLOWED.items()) for source, target in pairs]
    return F.broadcast(spark.createDataFrame(rows, "rel string, src_type string, dst_type string, priority int"))


def thresholds(kind: str | Column = "type", vector: bool = False) -> Column:
    c = F.lower(F.col(kind) if isinstance(kind, str) else kind)
    known = F.create_map(*[x for k, v in THRESHOLDS.items() for x in (F.lit(k), F.lit(v[vector]))])
    return F.coalesce(F.element_at(known, c), F.lit(OTHER_THRESHOLDS[vector]))


def canonical_name(df: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """canonical: the name that the alias table (alias, canonical) gives, else the name itself."""
    a = aliases.select(fold("alias").alias("_k"), F.col("canonical").alias("_c")).dropDuplicates(["_k"])
    return df.withColumn("_f", fold(name)).join(a, F.col("_f") == F.col("_k"), "left").withColumn("canonical", F.coalesce("_c", F.col(name))).drop("_f", "_k", "_c")


def _grams(name: str, q: int) -> Column:
    """Distinct q-grams; a shorter name is its own gram."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(name) - (q - 1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(name, i, F.lit(q))))


def _indels(n: Column, m: Column, percent: Column) -> Column:
    """Most insertions and deletions between names of lengths n and m whose ratio is `percent` or more (under 0: none can be)."""
    most = F.floor((1 - percent / 100) * (n + m) + 1e-9)
    most = most - F.pmod(most - n - m, F.lit(2))
    return F.when(most >= F.abs(n - m), most).otherwise(F.lit(-1)).cast("int")


def _length_class(n: Column) -> Column:
    """Lengths by powers of 1.1: short ones one by one, longer ones within a tenth."""
    return F.floor(F.log(F.greatest(n, F.lit(1))) / math.log(1.1) + 1e-9).cast("int")


def _of_like_length(name: str, others: DataFrame) -> Column:
    """Whether a name can reach its ratio `least` with one of the lengths between the shortest and the longest of the others."""
    n, wider = F.length(name), (200 - F.col("least")) / F.col("least")
    ends = others.agg(F.min(F.length(others.columns[0])), F.max(F.length(others.columns[0]))).head()
    return (n * wider + 1e-9 >= F.lit(ends[0])) & (n / wider - 1e-9 <= F.lit(ends[1]))


def name_keys_by_grams(names: DataFrame, frequency: DataFrame, partners: DataFrame, ask: bool, q: int = 2, by_size: bool = False) -> DataFrame:
    """(name, key, first, last) of names (name, least): keys such that two names with an indel ratio of `least` or more share one.

    A deletion spoils at most q of a name's q-grams and an insertion q - 1, so all but `spoilt` of them are in any
    partner of a given length, and the spoilt + 1 rarest grams of both names have one in common. A key is such a gram
    with the classes of both lengths; first and last are the gram's places in the name. Where a name has too few grams
    for a class it asks (+) for all names of the class, and every name offers (-) its own class. by_size: so does one
    that asks where its grams would meet more names than the class has. partners (to, size): the other side's names by class of lengths.
    """
    n, least = F.length("name"), F.col("least")
    reach = (200 - least) / least
    lengths = F.sequence(F.greatest(F.lit(1), F.ceil(n / reach - 1e-9).cast("int")), F.greatest(F.lit(1), F.floor(n * reach + 1e-9).cast("int")))

    def spoilt(m: Column) -> Column:
        most = _indels(n, m, least)
        return F.when(most < 0, F.lit(-1)).otherwise(F.floor(most * (q - 1) + (most + n - m) / 2)).cast("int")

    ranked = names.select("name", "least", F.explode(_grams("name", q)).alias("gram")).join(frequency, "gram").groupBy("name", "least").agg(F.sort_array(F.collect_list(F.struct("freq", "gram"))).alias("grams"))
    lengths = F.transform(lengths, lambda m: F.struct(_length_class(m).alias("to"), spoilt(m).alias("spoilt")))
    ranked = ranked.withColumn("lengths", F.filter(lengths, lambda x: x["spoilt"] >= 0))
    to = ranked.select("name", "grams", F.explode(F.array_distinct(F.transform("lengths", lambda x: x["to"]))).alias("to"), "lengths")
    to = to.withColumn("wanted", 1 + F.array_max(F.transform(F.filter("lengths", lambda x: x["to"] == F.col("to")), lambda x: x["spoilt"])))
    # one row for each class of lengths
    to = to.join(F.broadcast(partners), "to").withColumn("rarest", F.slice("grams", F.lit(1), F.col("wanted")))

    own = _length_class(n)
    few = (F.size("grams") < F.col("wanted")) | (n < q)
    if ask and by_size:
        common = F.aggregate("rarest", F.lit(0).cast("bigint"), lambda s, g: s + g["freq"]) > F.col("size")
    else:
        common = F.lit(False)
    none = F.lit(None).cast("int")
    entry = lambda key, first, last: F.struct(key.alias("key"), first.alias("first"), last.alias("last"))
    classes = F.concat_ws(">", own, F.col("to")) if ask else F.concat_ws(">", F.col("to"), own)
    by_gram = F.transform(
        F.col("rarest"),
        lambda g: entry(F.concat(F.lit("="), g["gram"], F.lit("|"), classes), F.instr(F.col("name"), g["gram"]), n - F.length(g["gram"]) + 2 - F.instr(F.reverse("name"), F.reverse(g["gram"]))),
    )
    plus, minus = ("+", "-") if ask else ("-", "+")
    by_class = F.transform(F.sequence(F.lit(0), F.lit(CLASS_PARTS - 1)), lambda p: entry(F.concat_ws("#", F.concat(F.lit(plus), F.col("to").cast("string")), p), none, none))
    nothing = F.array().cast("array<struct<key:string,first:int,last:int>>")
    both = F.concat(F.when(common, nothing).otherwise(by_gram), F.when(few | common, by_class).otherwise(nothing))
    keys = to.select("name", F.explode(both).alias("k")).select("name", "k.*")
    part = F.pmod(F.xxhash64("name"), F.lit(CLASS_PARTS))
    return keys.union(names.select("name", F.concat_ws("#", F.concat(F.lit(minus), own.cast("string")), part), none, none))


def name_candidates(left: DataFrame, right: DataFrame, percent: float, same: bool = False, q: int = 2, reach: DataFrame | None = None) -> DataFrame:
    """(a, b, least) of folded names that share a key, at places and of lengths that the ratio allows; pairs may repeat.

    least is `percent`, or what single names of the left ask for by reach (a, reach).
    """
    a = left.select(fold("name").alias("name")).where("name <> ''").distinct().withColumn("least", F.lit(float(percent)))
    if reach is not None:
        a = a.join(reach.select(F.col("a").alias("name"), "reach"), "name").select("name", F.greatest("reach", "least").alias("least"))
    b = a if same else right.select(fold("name").alias("name")).where("name <> ''").distinct().withColumn("least", F.lit(float(percent)))
    if not same:
        # names whose length no name of the right can match make no keys
        a = a.where(_of_like_length("name", b.select("name")))
    every = a.select("name") if same else a.select("name").union(b.select("name")).distinct()
    frequency = settled(every.select(F.explode(_grams("name", q)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("freq")))
    classes = lambda names: names.groupBy(_length_class(F.length("name")).alias("to")).agg(F.count(F.lit(1)).alias("size"))
    x = name_keys_by_grams(a, frequency, classes(b), True, q, reach is not None).toDF("a", "key", "first_a", "last_a")
    y = name_keys_by_grams(b, frequency, classes(a), False, q).toDF("b", "key", "first_b", "last_b")
    met = x.join(y, "key").where("a < b" if same else "true")
    if reach is None:
        met = met.withColumn("least", F.lit(float(percent)))
    else:
        met = met.join(a.toDF("a", "least"), "a")
    n, m = F.length("a"), F.length("b")
    most = _indels(n, m, F.col("least"))
    # a surviving gram moves left by the deletions at most, right by the insertions
    placed = (F.col("first_a") - F.col("last_b") <= (most + n - m) / 2) & (F.col("first_b") - F.col("last_a") <= (most - n + m) / 2)
    return met.where((most >= 0) & F.coalesce(placed, F.lit(True))).select("a", "b", "least")


def fuzzy_pairs(left: DataFrame, right: DataFrame, percent: float, same: bool = False, reach: DataFrame | None = None) -> DataFrame:
    """(a, b, ratio) of names that reach the ratio: candidates by rare grams, a bounded edit distance, then the exact ratio.

    reach (a, reach): greater ratios that the names of the left ask for, each one of them.
    """
    # few short rows with long work each: dealt to all tasks
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the edit distance is never over that of insertions and deletions alone
    near = name_candidates(left, right, percent, same, reach=reach).where(may_reach("a", "b", F.col("least"))).distinct()
    places = left.select(fold("name").alias("a")).distinct().where(F.length("a").between(1, 62)).select("a", char_places("a").alias("places"))
    near = near.join(places, "a", "left").repartition(tasks, "a", "b")
    n, m = F.length("a"), F.length("b")
    exact = F.when(F.col("places").isNotNull(), F.lit(200.0) * lcs_of_places("places", n, "b") / (n + m)).otherwise(indel_ratio("a", "b"))
    # settled, because filters on a ratio would count it again
    ratio = settled(near.select("a", "b", "least", exact.alias("ratio")))
    return ratio.where(F.col("ratio") >= F.col("least") - 1e-9).select("a", "b", "ratio")


def match_alias(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(mention, id) by name or alias, ignoring case and outer spaces."""
    return mentions.select("mention", fold("mention").alias("key")).distinct().join(name_keys(entities), "key").select("mention", "id")


def match_fuzzy(mentions: DataFrame, entities: DataFrame, percent: float | None = 85.0) -> DataFrame:
    """(mention, id, ratio): the best entity name of each mention, the least id of equals. percent None: the threshold of the mention's type."""
    lowest = 100 * min(t for t, _ in THRESHOLDS.values()) if percent is None else percent
    p = fuzzy_pairs(mentions.select(F.col("mention").alias("name")), entities.select("name"), lowest)
    e = entities.select("id", fold("name").alias("b")).groupBy("b").agg(F.min("id").alias("id"))
    least = 100 * thresholds() if percent is None else F.lit(float(percent))
    m = mentions.select("mention", fold("mention").alias("a"), least.alias("least")).distinct()
    near = p.join(e, "b").join(m, "a").where(F.col("ratio") >= F.col("least") - 1e-9)
    best = near.groupBy("mention").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "id")).alias("x"))
    return best.select("mention", "x.id", (-F.col("x.r")).alias("ratio"))


def match_embedding(mentions: DataFrame, entities: DataFrame, threshold: float | None = 0.9) -> DataFrame:
    """(query, id, score): the best entity of each mention (id, [type,] embedding) over the threshold; None: that of the mention's type."""
    if threshold is not None:
        return similar(mentions, entities, 1, threshold)
    near = similar(mentions, entities, None, min(v for _, v in THRESHOLDS.values()))
    near = near.join(mentions.select(F.col("id").alias("query"), thresholds(vector=True).alias("least")), "query").where(F.col("score") > F.col("least"))
    return near.groupBy("query").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("x")).select("query", "x.id", (-F.col("x.s")).alias("score"))


def best_names(asked: DataFrame, entities: DataFrame, levels: list[float]) -> DataFrame:
    """(m, id, method, score): for asked (m, least, a) the best entity (id, name, place) by place, ratio and id.

    A place is searched before the next one, and from the first level down: all names over a level are met, so a mention
    with one is done, and one whose least ratio is not under the level has none in this place.
    """
    found, names = None, entities.select(fold("name").alias("b"), "place", "id").groupBy("b", "place").agg(F.min("id").alias("id"))
    names = settled(names)
    for place in sorted(r.place for r in names.select("place").distinct().collect()):  # own and others
        own = names.where(F.col("place") == place).drop("place")
        like = _of_like_length("a", own.select("b"))
        waiting = asked.where(like)
        for level in levels:
            if waiting.isEmpty():
                break
            reach = waiting.groupBy("a").agg(F.min("least").alias("reach"))
            pairs = fuzzy_pairs(waiting.select(F.col("a").alias("name")), own.select(F.col("b").alias("name")), level, reach=reach)
            near = pairs.join(waiting, "a").where(F.col("ratio") >= F.col("least") - 1e-9).join(own, "b")
            first = near.groupBy("m").agg(F.min(F.struct((-F.col("ratio") / 100).alias("s"), "id")).alias("x"))
            hit = settled(first.select("m", "x.id", F.lit("fuzzy").alias("method"), (-F.col("x.s")).alias("score")))
            found = hit if found is None else found.unionByName(hit)
            asked = settled(asked.join(hit, "m", "left_anti"))
            waiting = asked.where(like & (F.col("least") < level))
    return asked.select("m", F.lit(None).cast("bigint").alias("id"), F.lit("fuzzy").alias("method"), F.lit(0.0).alias("score")).limit(0) if found is None else found


def resolve_entities(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, percent: float | None = 85.0, user_id: int | None = None) -> DataFrame:
    """(mention, [type,] id, method, score) of distinct mentions: exact, canonical, alias, fuzzy, embedding, else new (id NULL).

    Each stage sees only what the stages before it left, and in each one the tenant's own entities (user_id) go before
    all others, then the better score, then the least id. The embedding stage runs where both tables have a column
    `embedding`. percent None: least similarities by the type of the mention (the default ones where it has none).
    Stages are settled, so that a plan holds one stage only.
    """
    who = ["mention", "type"] if "type" in mentions.columns else ["mention"]
    vectors = "embedding" in mentions.columns and "embedding" in entities.columns
    own = F.lit(0) if user_id is None else F.when(F.col("user_id").eqNullSafe(F.lit(user_id)), 0).otherwise(1)
    e = entities.withColumn("place", own)
    asked = mentions.where(fold("mention") != "").groupBy(*who).agg(*([F.min("embedding").alias("embedding")] if vectors else [F.lit(None).cast("array<float>").alias("embedding")]))
    kind = F.col("type") if "type" in who else F.lit(None).cast("string")
    asked = asked.withColumns({"least": 100 * thresholds(kind) if percent is None else F.lit(float(percent)), "least_cosine": thresholds(kind, True) if percent is None else F.lit(OTHER_THRESHOLDS[1])})
    asked = settled(asked.withColumn("m", F.monotonically_increasing_id()))

    # names and aliases, in one join
    option = lambda key, on, stage: F.struct(fold(key).alias("key"), F.lit(on).alias("on"), F.lit(stage).alias("stage"))
    options = canonical_name(asked, aliases, "mention").select("m", F.explode(F.array(option("mention", "name", 0), option("canonical", "name", 1), option("mention", "alias", 2))).alias("o")).select("m", "o.*")
    known = e.select("id", "place", fold("name").alias("key"), F.lit("name").alias("on"))
    if "aliases" in e.columns:
        known = known.union(e.select("id", "place", F.explode("aliases").alias("a")).select("id", "place", fold("a"), F.lit("alias")))
    known = known.groupBy("key", "on").agg(F.min(F.struct("place", "id")).alias("best"))
    hit = options.join(known, ["key", "on"]).groupBy("m").agg(F.min(F.struct("stage", "best")).alias("x"))
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), F.col("x.stage") + 1)
    by_key = settled(hit.select("m", F.col("x.best.id").alias("id"), pick("exact", "canonical", "alias").alias("method"), pick(1.0, 0.95, 0.92).alias("score")))

    def best(found: DataFrame, method: str) -> DataFrame:
        first = found.groupBy("m").agg(F.min(F.struct("place", (-F.col("score")).alias("s"), "id")).alias("x"))
        return first.select("m", "x.id", F.lit(method).alias("method"), (-F.col("x.s")).alias("score"))

    left = settled(asked.join(by_key, "m", "left_anti"))
    by_name = settled(best_names(left.select("m", "least", fold("mention").alias("a")), e, [percent] if percent is not None else [*LEVELS, 100 * min(t for t, _ in THRESHOLDS.values())]))

    found = by_key.unionByName(by_name)
    if vectors:
        # mentions take ids below those of entities, so that none is left out as the entity itself
        left = left.join(by_name, "m", "left_anti").where("embedding IS NOT NULL").withColumn("query", -F.col("m") - 1)
        lowest = OTHER_THRESHOLDS[1] if percent is not None else min(v for _, v in THRESHOLDS.values())
        close = similar(left.select(F.col("query").alias("id"), "embedding"), e.where("embedding IS NOT NULL").select("id", "embedding"), None, lowest)
        close = close.join(left.select("query", "m", "least_cosine"), "query").where(F.col("score") > F.col("least_cosine")).join(e.select("id", "place"), "id")
        found = found.unionByName(best(close, "embedding"))
    out = asked.join(found, "m", "left")
    return out.select(*who, F.col("id"), F.coalesce("method", F.lit("new")).alias("method"), F.coalesce("score", F.lit(1.0)).alias("score"))


def resolve_batch(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, percent: float | None = 85.0, user_id: int | None = None) -> DataFrame:
    """Every mention row with its resolution; equal canonical names resolve once, by their least spelling."""
    m = settled(canonical_name(mentions, aliases, "mention").withColumn("key", fold("canonical")).drop("canonical"))
    rest = [F.min_by(c, "mention").alias(c) for c in ("type", "embedding") if c in m.columns]
    first = m.groupBy("key").agg(F.min("mention").alias("mention"), *rest)
    once = resolve_entities(first.drop("key"), entities, aliases, percent, user_id)
    by_key = first.select("key", "mention").join(once.select("mention", "id", "method", "score"), "mention").drop("mention")
    return m.join(by_key, "key", "left").drop("key")


def duplicate_pairs(entities: DataFrame, aliases: DataFrame | None = None, percent: float = 85.0) -> DataFrame:
    """(a, b, ratio, severity) of different folded names at or over the ratio; known aliases of each other are warnings."""
    p = fuzzy_pairs(entities, entities, percent, same=True)
    if aliases is None:
        return p.withColumn("severity", F.lit("INFO"))
    c = aliases.select(fold("alias").alias("x"), F.col("canonical").alias("cx")).dropDuplicates(["x"])
    p = p.join(c.toDF("a", "ca"), "a", "left").join(c.toDF("b", "cb"), "b", "left")
    return p.select("a", "b", "ratio", F.when(F.coalesce("ca", "a") == F.coalesce("cb", "b"), "WARNING").otherwise("INFO").alias("severity"))


def duplicate_groups(entities: DataFrame, percent: float = 85.0) -> DataFrame:
    """(name, primary): components of the duplicate pairs over numbered names, the first name standing for all."""
    from .integrity import components

    names = entities.select(fold("name").alias("name")).where("name <> ''").distinct().withColumn("id", F.xxhash64("name"))
    p = duplicate_pairs(entities, None, percent)
    edges = p.select(F.xxhash64("a").alias("src"), F.xxhash64("b").alias("dst"))
    c = components(names, edges).join(names, "id")
    first = c.groupBy("component").agg(F.min("name").alias("primary"))
    return c.join(first, "component").select("name", "primary")


def merge_entities(entities: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) after every secondary of mapping (secondary, primary) became its primary."""
    to = mapping.select(F.col("secondary").alias("_s"), F.col("primary").alias("_p"))
    entity_edge = F.col("rel") != "SUPERSEDES"
    for c in ("src", "dst"):
        at = entity_edge if c == "dst" else ~F.col("rel").isin("INVOLVES", "SUPERSEDES")
        edges = edges.join(to, (F.col(c) == F.col("_s")) & at, "left").withColumn(c, F.coalesce("_p", F.col(c))).drop("_s", "_p")
    edges = edges.where("src <> dst").dropDuplicates(["src", "dst", "rel"])
    moved = mapping.join(entities.select(F.col("id").alias("secondary"), "name"), "secondary").groupBy(F.col("primary").alias("id")).agg(F.sort_array(F.collect_set("name")).alias("more"))
    kept = entities.join(mapping.select(F.col("secondary").alias("id")), "id", "left_anti").join(moved, "id", "left")
    old = F.col("aliases") if "aliases" in entities.columns else F.array().cast("array<string>")
    return kept.withColumn("aliases", F.array_union(F.coalesce(old, F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>")))).drop("more"), edges


def upsert_entities(entities: DataFrame, new: DataFrame) -> DataFrame:
    """entities and those new rows whose folded name no entity has; of equal new names the least id."""
    first = new.withColumn("_k", fold("name")).withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy("id"))).where("_r = 1")
    fresh = first.join(entities.select(fold("name").alias("_k")).distinct(), "_k", "left_anti")
    return entities.unionByName(fresh.select(*entities.columns))


def resolve_files(mentions: DataFrame, files: DataFrame) -> DataFrame:
    """(mention, path, score): exact path or suffix after `/` (1.0), the only stem (.95), the shortest path of a shared stem (.80)."""
    m = mentions.select("mention").distinct()
    suffixes = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), -i, i), "/"))
    shortest = F.min(F.struct(F.length("path").alias("n"), "path"))["path"]
    full = files.select("path", F.explode(suffixes).alias("mention")).join(m, "mention").groupBy("mention").agg(shortest.alias("path")).withColumn("score", F.lit(1.0))
    rest = m.join(full.select("mention"), "mention", "left_anti").withColumn("stem", F.lower(stem("mention"))).where("stem <> ''")
    by = files.select("path", F.lower(stem("path")).alias("stem")).join(rest, "stem").groupBy("mention").agg(shortest.alias("path"), F.count(F.lit(1)).alias("n"))
    return full.unionByName(by.select("mention", "path", F.when(F.col("n") == 1, 0.95).otherwise(0.80).alias("score")))


def tool_path(c: Column, root: str = "") -> Column:
    """A tool's path without the repository's prefix and a leading ./"""
    c = F.trim(c)
    c = F.when(F.startswith(c, F.lit(root)), F.substring(c, len(root) + 1, 1 << 20)).otherwise(c) if root else c
    return F.regexp_replace(c, r"^(\./|/)+", "")


def language_of(c: str | Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(known, F.lower(extension(c))), F.lit("unknown"))


def validate_relations(rels: DataFrame) -> DataFrame:
    """rels (src, dst, rel, src_type, dst_type, confidence) with reason, and the relationship and confidence to store."""
    rules = allowed_relations(rels.sparkSession).select("rel", "src_type", "dst_type")
    r = rels.withColumns({"rel": F.upper("rel"), "src_type": F.lower("src_type"), "dst_type": F.lower("dst_type")})
    r = r.join(rules.withColumn("ok", F.lit(True)), ["rel", "src_type", "dst_type"], "left")
    r = r.join(rules.select("rel", F.col("src_type").alias("dst_type"), F.col("dst_type").alias("src_type"), F.lit(True).alias("back")), ["rel", "src_type", "dst_type"], "left")
    reason = F.when(F.col("rel").isin(DECISION_RELS), "decisions_only").when(F.col("rel") == "INVOLVES", "decision_to_entity").when(~F.col("rel").isin(list(ALLOWED)), "unknown").when(F.col("ok"), None).when(F.col("back"), "reversed").otherwise("not_allowed")
    bad = reason.isNotNull()
    return r.withColumns({"reason": reason, "stored_rel": F.when(bad, "RELATED_TO").otherwise(F.col("rel")), "stored_confidence": F.when(bad, F.col("confidence") * 0.8).otherwise(F.col("confidence"))}).drop("ok", "back")


def suggest_relation(pairs: DataFrame) -> DataFrame:
    """pairs (src_type, dst_type) with the first allowed relationship, RELATED_TO if there is none."""
    rules = allowed_relations(pairs.sparkSession)
    best = rules.groupBy("src_type", "dst_type").agg(F.min_by("rel", "priority").alias("suggested"))
    return pairs.join(F.broadcast(best), ["src_type", "dst_type"], "left").withColumn("suggested", F.coalesce("suggested", F.lit("RELATED_TO")))


def relation_edges(rels: DataFrame, entities: DataFrame, parts: int = 8) -> DataFrame:
    """(src, dst, rel) of relations by name (from, to, rel): names or aliases, no self loops, each once.

    As many rows as the holders of both names have pairs. Relations are made distinct by key before they meet entities,
    so only pairs with an entity of several keys can come twice and are compared. Holders of the second name are dealt
    to `parts` parts of their key, as few names may have most of them.
    """
    keys = settled(name_keys(entities))
    many = keys.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("many"))
    keys = settled(keys.join(many, "id"))
    r = rels.select(fold("from").alias("f"), fold("to").alias("t"), "rel").distinct()

    def met(first: str, second: str) -> DataFrame:
        # entities are chosen before they meet: a choice between pairs would make all pairs once more
        left = r.join(keys.where(first).select(F.col("key").alias("f"), F.col("id").alias("src")), "f")
        left = left.select("t", "rel", "src", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        right = keys.where(second).select(F.col("key").alias("t"), F.col("id").alias("dst"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
        return left.join(right.hint("merge"), ["t", "part"]).where("src <> dst").select("src", "dst", "rel")

    return met("NOT many", "NOT many").unionByName(met("many", "true").unionByName(met("NOT many", "many")).distinct())


def suggest_entities(mentions: DataFrame, entities: DataFrame, k: int = 3) -> DataFrame:
    """(mention, name): up to k entity names that hold the mention, NULL where none does."""
    from .search import suggest

    s = suggest(mentions.select(F.col("mention").alias("query")), entities, k).select(F.col("query").alias("mention"), "name")
    return s.unionByName(mentions.select("mention").distinct().join(s.select("mention"), "mention", "left_anti").select("mention", F.lit(None).cast("string").alias("name")))
