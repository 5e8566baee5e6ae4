"""Rules around extracted decisions: episodes, validity, confidence, spans, scans and quality figures."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, filled, first_filled, half_even, words

#: Fixed values of the episode rules.
EXPLORE_TOOLS = ["Read", "Glob", "Grep", "Bash", "WebFetch", "WebSearch"]
WRITE_TOOLS = ["Edit", "Write", "NotebookEdit"]
CLOSING = ["done", "looks good", "perfect", "let's move on", "next step", "lgtm", "approved", "thank you", "thanks", "great", "ship it"]
#: Keywords by decision type, in order of preference.
TYPE_WORDS = {
    "architecture": ["architecture", "microservice", "monolith", "distributed", "scalability", "api gateway", "event-driven", "message queue", "load balancer"],
    "technology": ["framework", "library", "database", "postgres", "mongodb", "redis", "react", "vue", "python", "typescript", "aws", "docker"],
    "process": ["workflow", "process", "ci/cd", "deployment", "code review", "branching", "agile", "sprint", "release"],
}
#: Triggers of the extraction examples, and quality phrases of a rationale.
EXAMPLE_TRIGGERS = ["need to select a database for the project", "need to choose frontend framework", "need to choose a styling approach", "need for better type safety in component"]
QUALITY_PHRASES = ["because", "since", "due to", "trade-off", "benefit", "compared to"]
#: Keywords by part of a decision, and how many make it fully covered.
COVERAGE = {
    "trigger": (5, ["problem", "issue", "need", "require", "had to", "wanted to", "because", "since", "when", "started", "began", "noticed", "realized", "discovered", "faced", "encountered", "challenge"]),
    "context": (5, ["already", "existing", "current", "before", "had", "constraint", "limit", "budget", "deadline", "team", "experience", "skill", "environment", "stack", "using", "requirement", "needed to", "had to support"]),
    "options": (4, ["option", "alternative", "considered", "looked at", "evaluated", "compared", "versus", "vs", "or", "could have", "might have", "other", "different", "instead", "also thought", "ruled out"]),
    "decision": (3, ["decided", "chose", "went with", "picked", "selected", "ended up", "final", "ultimately", "concluded", "settled on", "we use", "we're using", "implemented", "adopted"]),
    "rationale": (4, ["because", "since", "reason", "why", "benefit", "advantage", "better", "easier", "faster", "cheaper", "simpler", "more", "trade-off", "tradeoff", "downside", "risk", "concern", "weighed", "balanced", "considered"]),
}
STAGES = list(COVERAGE)
#: Injection patterns (category, flags, pattern) and the weights of categories.
INJECTION = [
    ("system_override", "im", r"\b(?:ignore|disregard|forget|override|bypass)\s+(?:all\s+)?(?:previous|prior|above|system)\s+(?:instructions?|prompts?|rules?|guidelines?)"),
    ("system_override", "im", r"\b(?:new|actual|real)\s+(?:system\s+)?(?:instructions?|prompt)\s*[:\-]"),
    ("role_hijack", "im", r"\byou\s+are\s+(?:now|actually)\s+(?:a|an)\b"),
    ("role_hijack", "im", r"\bact\s+as\s+(?:if\s+)?(?:you\s+(?:are|were)\s+)?(?:a|an|the)\b"),
    ("role_hijack", "im", r"\bpretend\s+(?:you\s+are|to\s+be)\b"),
    ("behavior_override", "im", r"\bfrom\s+now\s+on\b.*\byou\s+(?:will|must|should)\b"),
    ("boundary_attack", "im", r"###\s*(?:system|instruction|prompt)"),
    ("boundary_attack", "im", r"\[(?:SYSTEM|INST|INSTRUCTION)\]"),
    ("boundary_attack", "im", r"<(?:system|instruction|prompt)>"),
    ("role_injection", "im", r"(?:^|\n)(?:System|Assistant|Human):"),
    ("jailbreak", "im", r"\bDAN\s*(?:mode|prompt)?\b"),
    ("jailbreak", "im", r"\bdev(?:eloper)?\s+mode\b"),
    ("jailbreak", "im", r"\bunrestricted\s+mode\b"),
    ("jailbreak", "im", r"\bno\s+(?:restrictions?|limits?|filters?)\b"),
    ("hidden_instruction", "is", r"\[hidden\].*?\[/hidden\]"),
    ("html_comment_injection", "is", r"<!--.*?-->"),
    ("code_comment_injection", "is", r"/\*.*?\*/"),
    ("invisible_chars", "is", r"[\u200b-\u200f\u2028-\u202f\ufeff]"),
    ("control_chars", "is", r"[\x00-\x08\x0b\x0c\x0e-\x1f]"),
    ("encoded_instruction", "is", r"(?:execute|run|decode|eval)\s*(?:base64|b64)"),
    ("data_exfil", "i", r"\b(?:output|print|return|show|display|reveal)\s+(?:your|the|all)\s+(?:system\s+)?(?:prompt|instructions?|rules?|context)"),
    ("data_exfil", "i", r"\b(?:what|show|tell)\s+(?:are|me)\s+(?:your|the)\s+(?:system\s+)?(?:instructions?|prompt|rules?)"),
    ("format_override", "i", r"respond\s+only\s+(?:with|in)\s+(?:json|xml|code)"),
    ("output_restriction", "i", r"(?:never|don'?t|do\s+not)\s+(?:mention|say|include|add)\b"),
]
#: For each pattern, groups of words: a text with a match holds one of each group (in small letters).
HINTS = [
    (("ignore", "disregard", "forget", "override", "bypass"), ("previous", "prior", "above", "system"), ("instruction", "prompt", "rule", "guideline")),
    (("instruction", "prompt"), ("new", "actual", "real")),
    (("you",), ("are",), ("now", "actually")),
    (("act",), ("as",)),
    (("pretend",),),
    (("from",), ("now",), ("you",), ("will", "must", "should")),
    (("###",), ("system", "instruction", "prompt")),
    (("[system]", "[inst"),),
    (("<system>", "<instruction>", "<prompt>"),),
    (("system:", "assistant:", "human:"),),
    (("dan",),),
    (("mode",), ("dev",)),
    (("unrestricted",), ("mode",)),
    (("restriction", "limit", "filter"), ("no",)),
    (("[hidden]",), ("[/hidden]",)),
    (("<!--",), ("-->",)),
    (("/*",), ("*/",)),
    (),
    (),
    (("base64", "b64"), ("execute", "run", "decode", "eval")),
    (("prompt", "instruction", "rule", "context"), ("output", "print", "return", "show", "display", "reveal"), ("your", "the", "all")),
    (("instruction", "prompt", "rule"), ("what", "show", "tell"), ("your", "the")),
    (("respond",), ("only",), ("json", "xml", "code")),
    (("never", "don", "do"), ("mention", "say", "include", "add")),
]
WEIGHTS = {
    "system_override": 0.9, "role_hijack": 0.8, "behavior_override": 0.7, "boundary_attack": 0.85, "role_injection": 0.75, "jailbreak": 0.95, "hidden_instruction": 0.6, "html_comment_injection": 0.4,
    "code_comment_injection": 0.3, "invisible_chars": 0.5, "control_chars": 0.4, "encoded_instruction": 0.7, "data_exfil": 0.6, "format_override": 0.3, "output_restriction": 0.4,
}
INVISIBLE = r"[\x{200b}-\x{200f}\x{2028}-\x{202f}\x{feff}\x{ad}]"


def hits(c: Column, keys: list[str]) -> Column:
    """How many of the keys the lower-cased text holds."""
    return F.size(F.filter(F.array(*map(F.lit, keys)), lambda k: F.contains(F.lower(c), k)))


def episodes(messages: DataFrame, gap_minutes: float = 10.0) -> DataFrame:
    """(conv_id, episode, turn_start, n, arc, tools): messages (conv_id, turn_index, role, content, ts, tools) cut at boundaries.

    Counters restart at every boundary, so the cut is a fold over a conversation's small rows (flags and
    tool names, not texts). A cluster of one message that ends at a boundary is dropped.
    """
    closing = hits(F.coalesce("content", F.lit("")), CLOSING) > 0
    tools = F.coalesce("tools", F.array().cast("array<string>"))
    row = F.struct(
        F.col("turn_index").cast("int").alias("turn"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"),
        ((F.col("role") == "user") & closing).alias("closing"),
        (F.col("role") == "user").alias("user"),
        tools.alias("tools"),
    )
    conv = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    count = lambda a, names: F.size(F.filter(a, lambda t: t.isin(names)))
    zero = F.array().cast("array<string>")
    state = F.struct(F.lit(0).alias("i"), F.lit(0).alias("episode"), zero.alias("cluster"), F.array().cast("array<int>").alias("out"), F.array().cast("array<int>").alias("ends"))

    def step(a: Column, r: Column) -> Column:
        cluster = F.concat(a["cluster"], r["tools"])
        late = F.get(F.col("rows"), a["i"] + 1)["t"] - r["t"] > gap_minutes * 60
        end = ((count(cluster, WRITE_TOOLS) > 0) & (count(cluster, EXPLORE_TOOLS) >= 2)) | F.coalesce(late, F.lit(False)) | (r["user"] & (F.size(cluster) >= 3)) | r["closing"]
        return F.struct(
            (a["i"] + 1).alias("i"), (a["episode"] + end.cast("int")).alias("episode"), F.when(end, zero).otherwise(cluster).alias("cluster"),
            F.array_append(a["out"], a["episode"]).alias("out"), F.array_append(a["ends"], end.cast("int")).alias("ends"),
        )

    cut = conv.select("conv_id", "rows", F.aggregate("rows", state, step, lambda a: F.arrays_zip(a["out"].alias("episode"), a["ends"].alias("ends"))).alias("cut"))
    flat = cut.select("conv_id", F.size("rows").alias("total"), F.explode(F.arrays_zip("rows", "cut")).alias("x")).select("conv_id", "total", "x.rows.turn", "x.rows.tools", "x.cut.episode", "x.cut.ends")
    e = flat.groupBy("conv_id", "episode").agg(F.min("turn").alias("turn_start"), F.count(F.lit(1)).alias("n"), F.max("ends").alias("closed"), F.flatten(F.collect_list("tools")).alias("tools"), F.max("total").alias("total"))
    kept = e.where((F.col("n") >= 2) | (F.col("closed") == 0) | (F.col("total") == 1))
    return kept.select("conv_id", "episode", "turn_start", "n", arc_label(F.col("tools"), F.col("n")).alias("arc"), F.sort_array("tools").alias("tools"))


def arc_label(tools: Column, n: Column) -> Column:
    write = F.exists(tools, lambda t: t.isin(WRITE_TOOLS))
    explore = F.exists(tools, lambda t: t.isin(EXPLORE_TOOLS))
    return F.when(F.size(tools) == 0, F.when(n <= 2, "setup").otherwise("verification")).when(write & ~explore, "implementation").when(write & explore, "pivot").when(explore, "exploration").otherwise("unknown")


def decision_type(c: Column) -> Column:
    """The type with the most keywords, the first of equals; general under two."""
    n = {t: hits(c, ws) for t, ws in TYPE_WORDS.items()}
    top = F.greatest(*n.values())
    out = F.when(top < 2, "general")
    for t, x in n.items():
        out = out.when(x == top, t)
    return out


def rejection(df: DataFrame) -> Column:
    """Why an extracted decision is not stored; NULL if it is."""
    d, t = F.trim(F.coalesce("agent_decision", F.lit(""))), F.trim(F.coalesce("trigger", F.lit("")))
    return (
        F.when(F.lower(t).isin(EXAMPLE_TRIGGERS), "example").when(F.length(d) == 0, "no decision").when(F.length(d) < 10, "short decision").when(F.length(t) == 0, "no trigger")
        .when(t == "Unknown trigger", "placeholder").when(F.coalesce("confidence", F.lit(0.0)) < 0.3, "low confidence")
    )


def valid_decisions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    judged = df.withColumn("reason", rejection(df))
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def completeness(least: int = 20, option: int = 5, strict: bool = False) -> Column:
    """Share of trigger, context, options, decision and rationale that are filled."""
    more = (lambda a, b: a > b) if strict else (lambda a, b: a >= b)
    texts = [more(F.length(F.trim(F.coalesce(c, F.lit("")))), least) for c in ("trigger", "context", "agent_decision", "agent_rationale")]
    options = F.exists(F.coalesce("options", F.array().cast("array<string>")), lambda o: more(F.length(o), option))
    return sum((x.cast("int") for x in texts), options.cast("int")) / 5


def _missing() -> Column:
    return sum((filled(c).isNull().cast("int") for c in ("trigger", "agent_decision", "agent_rationale")), F.lit(0))


def confidence_heuristic(places: int = 3) -> Column:
    raw = F.coalesce("raw_confidence", F.lit(0.5))
    n_options = F.size(F.coalesce("options", F.array().cast("array<string>")))
    why = F.coalesce("agent_rationale", F.lit(""))
    n_why, n_context = F.size(words(why)), F.size(words(F.coalesce("context", F.lit(""))))
    c = raw - 0.15 * _missing() + F.when(n_options >= 2, 0.05).otherwise(0.0) + F.when(n_options >= 3, 0.03).otherwise(0.0)
    c = c + F.when(n_why >= 20, 0.05).when(n_why >= 10, 0.02).when(n_why < 5, -0.10).otherwise(0.0) + F.when(n_context >= 5, 0.03).otherwise(0.0)
    return half_even(clamp(c + F.least(hits(why, QUALITY_PHRASES) * 0.02, F.lit(0.08)), 0.1), places)


def confidence_temperature(t: float = 1.5) -> Column:
    raw = F.coalesce("raw_confidence", F.lit(0.5))
    return F.when(raw <= 0, 0.0).when(raw >= 1, 1.0).otherwise(half_even(clamp(F.pow(raw, F.lit(1 / t)) * (1 - 0.05 * _missing())), 3))


def confidence_composite(text: Column, author: Column, places: int = 3) -> Column:
    """0.4 raw + 0.3 completeness + 0.2 evidence of the quote in the text + 0.1 source of the rationale."""
    quote = first_filled("verbatim_decision", "verbatim_trigger")
    w = words(F.lower(quote))
    found = F.size(F.filter(w, lambda x: F.contains(F.lower(text), x))) / F.size(w)
    evidence = F.when(quote.isNull() | (F.coalesce(F.length(text), F.lit(0)) == 0), 0.35).when(F.contains(F.lower(text), F.lower(F.trim(quote))), 1.0).when(found >= 0.6, 0.5).otherwise(0.2)
    source = F.when(author == "thinking", 1.0).when(author == "user", 0.85).otherwise(0.6)
    return half_even(clamp(F.coalesce("raw_confidence", F.lit(0.5)) * 0.4 + completeness(strict=True) * 0.3 + evidence * 0.2 + source * 0.1), places)


def rationale_author(decisions: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, author): thinking if any message of the conversation thinks, user if a user wrote the rationale's start, else assistant."""
    m = messages.groupBy("conv_id").agg(F.max(F.coalesce(F.length("thinking"), F.lit(0)) > 0).alias("thinks"), F.collect_list(F.when(F.col("role") == "user", F.lower("content"))).alias("said"))
    head = F.lower(F.substring("agent_rationale", 1, 50))
    by_user = (F.length("agent_rationale") > 10) & F.exists("said", lambda s: F.contains(s, head))
    return decisions.join(m, "conv_id", "left").select("id", F.when(F.col("thinks"), "thinking").when(by_user, "user").otherwise("assistant").alias("author"))


def find_spans(quotes: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, turn_index, start_char, end_char): the first place of a quote in its conversation, white space and case ignored.

    Quote and text are compared as words joined by one space; offsets come from the words' own lengths in the
    original, through a pattern built from the quote.
    """
    norm = lambda c: F.array_join(words(F.lower(c)), " ")
    j = quotes.where(F.length(F.trim("quote")) > 0).join(messages.select("conv_id", "turn_index", "content"), "conv_id").where(F.contains(norm(F.col("content")), norm(F.col("quote"))))
    quoted = F.transform(words(F.col("quote")), lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}_])", r"\\$1"))
    match = F.expr("regexp_substr(content, pattern)")
    j = j.withColumn("pattern", F.concat(F.lit("(?iu)"), F.array_join(quoted, "\\s+"))).withColumn("hit", match).where("hit IS NOT NULL")
    at = F.instr(F.col("content"), F.col("hit")) - 1
    j = j.select("id", "turn_index", at.alias("start_char"), (at + F.length("hit")).alias("end_char"))
    return j.groupBy("id").agg(F.min(F.struct("turn_index", "start_char", "end_char")).alias("x")).select("id", "x.*")


def apply_verdicts(decisions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts (id, is_valid, agent_decision, agent_rationale): invalid rows drop to confidence .1, corrections override."""
    v = verdicts.select(F.col("id").alias("_id"), "is_valid", F.col("agent_decision").alias("_d"), F.col("agent_rationale").alias("_r"))
    j = decisions.join(v, F.col("id") == F.col("_id"), "left")
    bad = F.coalesce(~F.col("is_valid"), F.lit(False))
    return j.withColumns({"confidence": F.when(bad, 0.1).otherwise(F.col("confidence")), "rejected": bad, "agent_decision": F.coalesce(filled("_d"), "agent_decision"), "agent_rationale": F.coalesce(filled("_r"), "agent_rationale")}).drop("_id", "_d", "_r", "is_valid")


def apply_patches(decisions: DataFrame, patches: DataFrame) -> DataFrame:
    """Gleaned fields fill blanks only."""
    own = [c for c in patches.columns if c != "id"]
    p = patches.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in own])
    return decisions.join(p, F.col("id") == F.col("_id"), "left").withColumns({c: F.coalesce(filled(c), filled(f"_{c}")) for c in own}).drop("_id", *[f"_{c}" for c in own])


def content_coverage(messages: DataFrame) -> DataFrame:
    """(conv_id, one column for each part): share of the needed keywords in the users' words."""
    user = F.when(F.col("role") == "user", F.struct("turn_index", F.lower("content").alias("c")))
    said = messages.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(user)), lambda x: x["c"]), " ").alias("t"), F.count_if((F.col("role") == "user") & (F.length(F.trim("content")) > 20)).alias("n_user"))
    return said.select("conv_id", "n_user", *[F.least(F.lit(1.0), hits(F.col("t"), ws) / n).alias(k) for k, (n, ws) in COVERAGE.items()])


def interview_stage(messages: DataFrame) -> DataFrame:
    """(conv_id, stage): by count up to one longer user message, else the first part under .4, else summarizing or by count."""
    c = content_coverage(messages)
    by_count = F.when(F.col("n_user") < len(STAGES), F.element_at(F.array(*map(F.lit, STAGES)), F.least(F.col("n_user") + 1, F.lit(len(STAGES))).cast("int"))).otherwise("summarizing")
    stage = F.when(F.col("n_user") <= 1, by_count)
    for s in STAGES:
        stage = stage.when(F.col(s) < 0.4, s)
    mean = sum((F.col(s) for s in STAGES[1:]), F.col(STAGES[0])) / len(STAGES)
    return c.select("conv_id", stage.when(mean >= 0.5, "summarizing").otherwise(by_count).alias("stage"))


def injection_scan(df: DataFrame, text: str = "text", strict: bool = False) -> DataFrame:
    """df with n_patterns, top_category weight, confidence and level; structural concerns raise the confidence by .1 each.

    A pattern is counted only where plain searches find one of each of its groups of hints. strict: line feeds and tabs count as
    control characters.
    """
    df = df.withColumn("_small", F.lower(text))
    counts = []
    for (category, flags, pattern), hints in zip(INJECTION, HINTS):
        if strict and category == "control_chars":
            pattern = r"[\x00-\x1f]"
        n = F.coalesce(F.regexp_count(F.col(text), F.lit(f"(?{flags}){pattern}")), F.lit(0))
        if hints:
            held = [functools.reduce(Column.__or__, [F.contains("_small", F.lit(h)) for h in group]) for group in hints]
            n = F.when(functools.reduce(Column.__and__, held), n).otherwise(0)
        counts.append((category, n))
    names = [f"_n{i}" for i in range(len(counts))]
    df = df.withColumns({n: c for n, (_, c) in zip(names, counts)} | {"_s": F.coalesce(structure_concerns(text), F.lit(0))}).drop("_small")
    n = sum((F.col(x) for x in names), F.lit(0))
    top = F.greatest(*[F.when(F.col(x) > 0, F.lit(WEIGHTS[c])).otherwise(F.lit(0.0)) for x, (c, _) in zip(names, counts)])
    found = F.col("max_weight") * F.least(F.lit(1.0), 0.5 + F.col("n_patterns") * 0.1)
    conf = F.when(F.col("n_patterns") == 0, F.when(F.col("_s") > 0, 0.2).otherwise(0.0)).otherwise(F.least(F.lit(1.0), found + 0.1 * F.col("_s")))
    level = F.when(F.col("confidence") >= 0.8, "CRITICAL").when(F.col("confidence") >= 0.6, "HIGH").when(F.col("confidence") >= 0.4, "MEDIUM").when(F.col("confidence") > 0, "LOW").otherwise("NONE")
    return df.withColumn("n_patterns", n).withColumn("max_weight", top).drop(*names).withColumn("confidence", F.round(conf, 6)).withColumn("level", level).drop("_s")


def structure_concerns(text: str = "text") -> Column:
    """Number of structural concerns: role-like lines, headers of fake sections, many symbols, many prompt markers."""
    c = F.col(text)
    roles = F.regexp_count(c, F.lit(r"(?m)^[ \t]*[A-Z][a-z]+:"))
    headers = F.contains(c, F.lit("#")) & F.rlike(c, F.lit(r"(?im)^#{1,6}\s+(?:system|instruction|prompt|context)"))
    special = F.length(F.regexp_replace(c, r"[\p{L}\p{N}\s]+", "")) / F.greatest(F.length(c), F.lit(1)) > 0.3
    markers = F.regexp_count(c, F.lit(r"(?i)(?:prompt|instruction|system|context)\s*[:\-]")) > 2
    return roles + headers.cast("int") + special.cast("int") + markers.cast("int")


def sanitize_prompts(df: DataFrame, text: str = "text") -> DataFrame:
    """df (with level) with sanitized and modified: invisible characters always go; from MEDIUM on role markers and boundaries are neutralised."""
    clean = F.regexp_replace(F.col(text), INVISIBLE, "")
    safe = F.regexp_replace(clean, r"(^|\n)(System|Assistant|Human|User):", '$1"$2:"')
    for pattern, by in ((r"(?i)###\s*(system|instruction|prompt)", "[user mentioned: $1]"), (r"(?i)\[(SYSTEM|INST|INSTRUCTION)\]", "[user mentioned: $1]"), (r"(?i)<(system|instruction|prompt)>", "[user mentioned: $1]"), (r"(?i)</(system|instruction|prompt)>", "[user mentioned: end $1]")):
        safe = F.regexp_replace(safe, pattern, by)
    out = F.when(F.col("level").isin("MEDIUM", "HIGH", "CRITICAL"), safe).otherwise(clean)
    return df.withColumn("sanitized", out).withColumn("modified", F.col("sanitized") != F.col(text))


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|0?[0-9]?[0-9])"


def mask_pii(c: Column) -> Column:
    """Masks tokens, e-mail names, IPv4 addresses and the values of secret keys."""
    c = F.regexp_replace(c, r"\beyJ[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*\b", "[MASKED_JWT]")
    c = F.regexp_replace(c, r"\b([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z|]{2,})\b", "$1***@$2")
    c = F.regexp_replace(c, rf"\b({_OCTET})\.{_OCTET}\.{_OCTET}\.{_OCTET}\b", "$1.***.***.**")
    return F.regexp_replace(c, r"""(?i)\b((?:api[_-]?key|apikey|bearer|token|secret|password|credential)[\s:=]+['"]?)[^\s'"]+""", "$1[MASKED]")


def recover_json(c: Column, expect_list: bool = False) -> Column:
    """The first part of a model's answer that parses: all of it, a json fence, any fence, an array, an object.

    expect_list: an object becomes a list of one; other values stay as they are.
    """
    whole = F.trim(c)
    parts = [whole, F.regexp_extract(c, r"(?s)```json\s*(.*?)```", 1), F.regexp_extract(c, r"(?s)```\w*\s*(.*?)```", 1), F.regexp_extract(c, r"(?s)\[.*\]", 0), F.regexp_extract(c, r"(?s)\{.*\}", 0)]
    found = F.coalesce(*[F.to_json(F.try_parse_json(F.when(F.length(p) > 0, p))) for p in parts])
    return F.when(F.startswith(found, F.lit("{")), F.concat(F.lit("["), found, F.lit("]"))).otherwise(found) if expect_list else found


def extraction_quality(extracted: DataFrame, truth: DataFrame) -> DataFrame:
    """(conv_id, matched, n_extracted, found, n_truth): texts match when either holds the other; empty ones never do."""
    e = extracted.where("text <> ''").select("conv_id", F.lower("text").alias("e"))
    t = truth.where("text <> ''").select("conv_id", F.lower("text").alias("t"))
    either = F.contains("e", F.col("t")) | F.contains("t", F.col("e"))
    a = e.join(t.withColumnRenamed("conv_id", "c"), (F.col("conv_id") == F.col("c")) & either, "left_semi").groupBy("conv_id").agg(F.count(F.lit(1)).alias("matched"))
    b = t.join(e.withColumnRenamed("conv_id", "c"), (F.col("conv_id") == F.col("c")) & either, "left_semi").groupBy("conv_id").agg(F.count(F.lit(1)).alias("found"))
    n = lambda df, name: df.groupBy("conv_id").agg(F.count(F.lit(1)).alias(name))
    out = n(extracted, "n_extracted").join(n(truth, "n_truth"), "conv_id", "full_outer").join(a, "conv_id", "left").join(b, "conv_id", "left")
    return out.fillna(0, ["n_extracted", "n_truth", "matched", "found"])


def exact_match_rate(extracted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: share of extracted quotes equal to a true one, white space and case ignored."""
    norm = F.array_join(words(F.lower("text")), " ")
    e = extracted.select("conv_id", norm.alias("k"))
    hit = e.join(truth.select("conv_id", norm.alias("k")).distinct().withColumn("ok", F.lit(1)), ["conv_id", "k"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("ok", F.lit(0))), 6).alias("rate"))


def nearest_rank(df: DataFrame, by: list[str], value: str, percents: list[int]) -> DataFrame:
    """Per group the sorted values at floor(n * p / 100), as p50 and so on."""
    w = Window.partitionBy(*by)
    r = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    at = lambda p: F.max(F.when(F.col("_r") == F.least(F.floor(F.col("_n") * p / 100), F.col("_n") - 1), F.col(value)))
    return r.groupBy(*by).agg(*[F.round(at(p), 6).alias(f"p{p}") for p in percents])


def latency_summary(requests: DataFrame, by: str = "endpoint") -> DataFrame:
    base = requests.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency"), 6).alias("mean"), F.round(100 * F.count_if(~F.col("ok")) / F.count(F.lit(1)), 6).alias("error_percent"))
    return base.join(nearest_rank(requests, [by], "latency", [50, 95, 99]), by, "left")


def compression_report(df: DataFrame, usd_per_million: float = 0.30) -> DataFrame:
    """One row of a table (original, compressed): characters, ratio, tokens and cost saved."""
    a, b = F.sum(F.length("original")), F.sum(F.length("compressed"))
    saved = F.sum(F.floor(F.length("original") / 4)) - F.sum(F.floor(F.length("compressed") / 4))
    return df.agg(a.alias("original_chars"), b.alias("compressed_chars"), F.round(b / a, 6).alias("ratio"), saved.cast("bigint").alias("tokens_saved"), F.round(saved * usd_per_million / 1e6, 6).alias("usd_saved"))


def with_provenance(df: DataFrame, method: str, source: Column, snippet: Column, confidence: Column) -> DataFrame:
    """provenance: nested record of source and extraction; the snippet is cut to 500 characters."""
    return df.withColumn("provenance", F.struct(F.struct(source.alias("source_type"), F.substring(snippet, 1, 500).alias("snippet")).alias("source"), F.struct(F.lit(method).alias("method"), confidence.alias("confidence")).alias("extraction")))


def episode_features(messages: DataFrame) -> DataFrame:
    """(conv_id, episode, thinking, files) of messages (conv_id, episode, turn_index, thinking, files): thoughts in order, distinct paths."""
    g = messages.groupBy("conv_id", "episode").agg(F.sort_array(F.collect_list(F.struct("turn_index", "thinking", "files"))).alias("rows"))
    thoughts = F.filter(F.transform("rows", lambda r: r["thinking"]), lambda t: t.isNotNull())
    files = F.array_distinct(F.flatten(F.transform("rows", lambda r: F.coalesce(r["files"], F.array().cast("array<string>")))))
    return g.select("conv_id", "episode", F.array_join(thoughts, "\n\n").alias("thinking"), F.array_sort(files).alias("files"))


def compare_models(runs: DataFrame) -> DataFrame:
    """Per model: precision, recall, F1 over summed matches, mean confidence, and nearest-rank p50 and p99 latency."""
    s = runs.groupBy("model").agg(F.sum("matched").alias("m"), F.sum("n_extracted").alias("e"), F.sum("found").alias("f"), F.sum("n_truth").alias("t"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))
    p, r = F.try_divide("m", "e"), F.try_divide("f", "t")
    s = s.withColumns({"precision": F.round(F.coalesce(p, F.lit(0.0)), 6), "recall": F.round(F.coalesce(r, F.lit(0.0)), 6), "f1": F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6)})
    return s.drop("m", "e", "f", "t").join(nearest_rank(runs, ["model"], "latency", [50, 99]), "model", "left")
