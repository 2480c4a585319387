"""Rules as data: validation, application and accrual of support."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnhelm.functions.checks import CHECKSUMS
from tarnhelm.functions.text import find_all
from tarnhelm.operators.detect import Detector, _bound, _collect, as_findings, detect
from tarnhelm.operators.literals import ENTRIES, LiteralIndex
from tarnhelm.schema import FAMILY_OF, FINDING_COLUMNS, hit, never_enforce_alone, no_hits

# Limits a learned rule has to respect.
MAX_CONFIDENCE = 0.65
MAX_PATTERN = 200
MAX_ANCHORS = 8
MAX_SPAN = 512
MIN_SUPPORT = 2
MAX_RULES = 200

RULE_SCHEMA = (
    "entity_class string, rationale string, anchors array<string>, pattern string, "
    "min_len int, max_len int, charset string, context array<string>, checksum string, "
    "confidence double, support bigint"
)


@dataclass(frozen=True)
class LearnedRule:
    entity_class: str
    pattern: str | None = None
    anchors: tuple[str, ...] = ()
    min_len: int = 8
    max_len: int = MAX_SPAN
    context: tuple[str, ...] = ()
    checksum: str | None = None
    confidence: float = 0.5
    rationale: str = ""
    charset: str | None = None
    support: int = 1
    #: A literal every match of the pattern contains; lets most texts skip the regex.
    needs: str | None = None

    @property
    def key(self) -> str:
        return f"{self.entity_class}:{self.pattern or ''}:{'|'.join(self.anchors)}"


def rule_key(entity_class: Column, pattern: Column, anchors: Column) -> Column:
    return F.concat_ws(
        ":", entity_class, F.coalesce(pattern, F.lit("")),
        F.coalesce(F.array_join(anchors, "|"), F.lit("")),
    )


def learned_hits(text: Column, rules: Sequence[LearnedRule]) -> Column:
    """Hits of every rule. A rule without a pattern takes the text after each anchor."""

    def confirm(m: Column, rule: LearnedRule) -> Column:
        value = m["value"]
        ok = F.length(value).between(rule.min_len, rule.max_len)
        if rule.checksum:
            ok = ok & CHECKSUMS[rule.checksum](value)
        return F.when(
            ok,
            hit(m["start"], m["end"], rule.entity_class,
                min(rule.confidence, MAX_CONFIDENCE), rule.key),
        )

    def from_anchor(m: Column, rule: LearnedRule) -> Column:
        value = F.substring(F.concat(m["value"], m["after"]), 1, rule.max_len)
        return F.struct(
            m["start"].alias("start"), (m["start"] + F.length(value)).alias("end"),
            value.alias("value"), m["before"].alias("before"), m["after"].alias("after"),
        )

    parts = []
    for rule in rules:
        if rule.pattern:
            cands = find_all(text, rule.pattern)
        else:
            cands = F.concat(
                *[
                    F.transform(
                        find_all(text, _literal(a), after=rule.max_len, shortest=len(a)),
                        _bound(from_anchor, rule),
                    )
                    for a in rule.anchors
                ]
            )
        found = _collect(cands, _bound(confirm, rule))
        gates = []
        if rule.context:
            low = F.lower(text)
            gates.append(_any([F.contains(low, F.lit(c.lower())) for c in rule.context]))
        if not rule.pattern:
            gates.append(_any([F.contains(text, F.lit(a)) for a in rule.anchors]))
        for g in gates:
            found = F.when(g, found).otherwise(no_hits())
        parts.append(found)
    return F.concat(*parts) if parts else no_hits()


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def _any(conds: Sequence[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def learned_detector(rules: Sequence[LearnedRule]) -> Detector:
    def gate(text: Column) -> Column:
        conds = []
        for r in rules:
            if not r.pattern:
                conds.extend(F.contains(text, F.lit(a)) for a in r.anchors)
            elif r.needs:
                conds.append(F.contains(text, F.lit(r.needs)) & text.rlike(r.pattern))
            else:
                conds.append(text.rlike(r.pattern))
        return _any(conds)

    return Detector("learned", gate, lambda text: learned_hits(text, rules))


def apply_learned_rules(
    spans: DataFrame, rules: Sequence[LearnedRule] | DataFrame, text: str = "text",
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Findings of the rules: a few of them become one scan expression, a table of any size is
    joined with the texts that hold what a rule cannot match without."""
    if isinstance(rules, DataFrame):
        return apply_rule_table(spans, rules, text, keys)
    return detect(spans, (learned_detector(rules),), text, keys)


_GAP = "\x01"


def needed_literal(pattern: Column) -> Column:
    """A literal that every match of the pattern contains; empty if none is certain.

    Escapes, classes, groups and whatever has a quantifier become gaps; the longest run between
    gaps is left. Alternatives, inline flags and anything not understood give none.
    """
    p = F.regexp_replace(pattern, r"\\[pP]\{[^}]*\}|\\x\{[^}]*\}|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}"
                         r"|\\0[0-7]+|\\c.|\\k<[^>]*>|\\.", _GAP)
    p = F.regexp_replace(p, r"\[\^?\]?[^\[\]]*\]", _GAP)
    depth = F.length(p) - F.length(F.replace(p, F.lit("("), F.lit("")))
    p = F.when(depth > 0, F.aggregate(
        F.sequence(F.lit(1), depth), p,
        lambda acc, _: F.regexp_replace(acc, r"\([^()]*\)", _GAP))).otherwise(p)
    p = F.regexp_replace(p, r"(?s).(?:[?*+]|\{\d*,?\d*\})[?+]?", _GAP)
    p = F.regexp_replace(p, r"[.^$]", _GAP)
    odd = pattern.rlike(r"\||\(\?[a-zA-Z-]|\\[QE]") | p.rlike(r"[\[\](){}*+?\\]")
    longest = F.aggregate(F.split(p, _GAP), F.lit(""), lambda acc, x: F.when(
        F.length(x) > F.length(acc), x).otherwise(acc))
    return F.when(odd, "").otherwise(longest)


def rule_index(rules: DataFrame, entries: int = ENTRIES) -> LiteralIndex:
    """An entry per pattern, under the literal that it needs, or per anchor. A pattern without
    such a literal has an empty one and is tried on every text."""
    plain = F.coalesce(F.col("pattern"), F.lit("")) == ""
    literals = F.when(plain, F.col("anchors")).otherwise(F.array(needed_literal(F.col("pattern"))))
    rows = rules.select(
        "entity_class", plain.alias("from_anchor"), F.explode(literals).alias("literal"),
        "pattern", "min_len", "max_len", "context", "checksum",
        F.least("confidence", F.lit(MAX_CONFIDENCE)).alias("confidence"),
        rule_key(F.col("entity_class"), F.col("pattern"), F.col("anchors")).alias("rule"))
    quoted = F.concat(F.lit("\\Q"), F.replace("literal", F.lit("\\E"), F.lit("\\E\\\\E\\Q")),
                      F.lit("\\E"))
    find = F.when(F.col("from_anchor"), quoted).otherwise(F.col("pattern"))
    return LiteralIndex(rows.select("*", find.alias("find")).drop("pattern"), entries)


def apply_rule_table(
    spans: DataFrame, rules: DataFrame, text: str = "text", keys: Sequence[str] | None = None,
    entries: int = ENTRIES,
) -> DataFrame:
    """Findings of a table of rules (RULE_SCHEMA) of any size.

    An inverted index leads from grams of the rules' literals to the rules. Each text looks up
    its own grams there and evaluates only the rules found, with pattern, lengths, context and
    checksum as columns. Text is never shuffled and no rule is collected.
    """
    keys = [c for c in spans.columns if c != text] if keys is None else list(keys)
    names = [f"_k_{i}" for i in range(len(keys))]
    source = spans.select(
        *[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)], F.col(text).alias("_text"))
    index = rule_index(rules, entries)
    most = index.rows.agg(F.max("max_len")).first()[0] or 1
    t = F.col("_text")

    def confirmed(m):
        value = F.when(F.col("from_anchor"), F.substring(
            F.concat(m["value"], m["after"]), F.lit(1), F.col("max_len"))).otherwise(m["value"])
        checked = F.col("checksum").isNull()
        for name, ok in CHECKSUMS.items():
            checked = checked | ((F.col("checksum") == name) & ok(value))
        return F.when(
            F.length(value).between(F.col("min_len"), F.col("max_len")) & checked,
            hit(m["start"], m["start"] + F.length(value), F.col("entity_class"),
                F.col("confidence"), F.col("rule")))

    def evaluated(pairs: DataFrame) -> DataFrame:
        lower = F.lower(t)
        fits = (F.coalesce(F.size("context"), F.lit(0)) <= 0) | F.exists(
            "context", lambda c: F.contains(lower, F.lower(c)))
        found = _collect(find_all(t, F.col("find"), after=max(1, most)), confirmed)
        return pairs.where(fits).select(*names, F.explode_outer(found).alias("_hit"))

    rows = index.lookup(source, F.array(t), evaluated)
    if rows is None:
        rows = source.select(*names, F.explode(no_hits()).alias("_hit"))
    return as_findings(rows, names).toDF(*keys, *FINDING_COLUMNS)


def _nested_quantifier(pattern: Column) -> Column:
    """A quantifier on a group that already holds one, such as ``(a+)+``.

    Escapes are removed, then the innermost groups are folded, once per opening bracket:
    a group with a quantifier inside becomes ``~``, any other becomes a plain letter.
    """
    plain = F.regexp_replace(pattern, r"\\.", "x")
    depth = F.length(plain) - F.length(F.replace(plain, F.lit("("), F.lit("")))
    start = F.struct(plain.alias("p"), F.lit(False).alias("bad"))

    def fold(acc, _):
        p = acc["p"]
        rest = F.regexp_replace(
            F.regexp_replace(p, r"\([^()]*[*+{~][^()]*\)", "~"), r"\([^()]*\)", "x"
        )
        return F.struct(
            rest.alias("p"),
            (acc["bad"] | p.rlike(r"\([^()]*[*+{~][^()]*\)[*+{]") | rest.rlike(r"~[*+{]"))
            .alias("bad"),
        )

    return F.coalesce(
        F.when(
            depth > 0,
            F.aggregate(F.sequence(F.lit(1), depth), start, fold, lambda acc: acc["bad"]),
        ),
        F.lit(False),
    )


def validate_rules(proposals: DataFrame) -> DataFrame:
    """Every proposal with ``accepted`` and ``reason``; confidence capped on acceptance."""
    c = F.col
    anchors = F.coalesce(
        F.filter(c("anchors"), lambda a: F.trim(a) != ""), F.array().cast("array<string>")
    )
    lo = F.coalesce(c("min_len"), F.lit(8))
    hi = F.coalesce(c("max_len"), F.lit(MAX_SPAN))
    conf = F.coalesce(F.nullif(c("confidence"), F.lit(0.0)), F.lit(0.5))
    reason = (
        F.when(c("entity_class").isNull() | ~c("entity_class").isin(*FAMILY_OF), "unknown class")
        .when((F.size(anchors) == 0) & c("pattern").isNull(), "no anchor and no pattern")
        .when(F.size(anchors) > MAX_ANCHORS, "too many anchors")
        .when(F.exists(anchors, lambda a: F.length(a) < 3), "anchor shorter than 3")
        .when(F.length("pattern") > MAX_PATTERN, "pattern too long")
        .when(
            c("pattern").rlike(r"\(\?R|\(\?\d|\(\?&|\(\?<|\{\d{3,},?\d*\}|\\[0-9]"),
            "forbidden construct",
        )
        .when(_nested_quantifier(c("pattern")), "nested quantifier")
        .when(
            c("checksum").isNotNull() & ~c("checksum").isin(*CHECKSUMS), "unknown checksum"
        )
        .when(~lo.between(1, MAX_SPAN) | ~hi.between(1, MAX_SPAN), "length out of range")
        .when(lo > hi, "min_len above max_len")
        .when((conf <= 0) | (conf > 1), "confidence out of range")
    )
    return proposals.withColumns(
        {
            "anchors": anchors,
            "min_len": lo,
            "max_len": hi,
            "context": F.transform(
                F.coalesce(c("context"), F.array().cast("array<string>")), F.lower
            ),
            "reason": reason,
            "accepted": reason.isNull(),
            "confidence": F.least(conf, F.lit(MAX_CONFIDENCE)),
        }
    )


def accrue_support(
    rules: DataFrame, proposals: DataFrame, profile: DataFrame | None = None
) -> DataFrame:
    """Merge accepted proposals into the rules: support adds up, confidence never moves.

    ``profile`` (one column ``entity_class``) drops proposals for classes the deployment
    does not enforce.
    """
    valid = validate_rules(proposals).filter("accepted").drop("accepted", "reason")
    if profile is not None:
        valid = valid.join(profile.select("entity_class").distinct(), "entity_class", "left_semi")
    known = rules.withColumn("_age", F.lit(0))
    fresh = valid.withColumn("_age", F.lit(1)).withColumn("support", F.lit(1).cast("bigint"))
    both = known.unionByName(fresh, allowMissingColumns=True).withColumn(
        "rule_key", rule_key(F.col("entity_class"), F.col("pattern"), F.col("anchors"))
    )
    fields = [x for x in rules.columns if x != "support"]
    first = F.min_by(F.struct(*fields), F.struct("_age", F.to_json(F.struct(*fields))))
    return both.groupBy("rule_key").agg(
        first.alias("_r"), F.sum("support").alias("support")
    ).select("rule_key", *[f"_r.{f}" for f in fields], "support")


def save_learned(
    rules: DataFrame, path: str | None = None, most: int | None = None
) -> DataFrame:
    """Rules with enough support, the best supported first; ``most`` keeps so many of them."""
    keep = rules.filter(F.col("support") >= MIN_SUPPORT).orderBy(F.desc("support"), "rule_key")
    if most is not None:
        keep = keep.limit(most)
    if path is not None:
        keep.write.mode("overwrite").json(path)
    return keep


def validate_pack(detectors: DataFrame) -> DataFrame:
    """Detector definitions with ``valid`` and the reason for quarantine.

    Columns: name, entity_class, anchors, pattern, max_span, advisory_only. A duplicate
    name among valid detectors quarantines all of its owners.
    """
    c = F.col
    anchors = F.coalesce(c("anchors"), F.array().cast("array<string>"))
    reason = (
        F.when(F.coalesce(c("name"), F.lit("")) == "", "name required")
        .when(c("entity_class").isNull(), "entity_class required")
        .when(~c("entity_class").isin(*FAMILY_OF), "unknown class")
        .when((F.size(anchors) == 0) & (F.coalesce(c("pattern"), F.lit("")) == ""),
              "no anchor and no pattern")
        .when(F.exists(anchors, lambda a: a == ""), "empty anchor")
        .when(c("max_span") <= 0, "max_span must be positive")
        .when(never_enforce_alone(c("entity_class")) & ~c("advisory_only"), "must be advisory")
        .when(F.length("pattern") > MAX_PATTERN, "pattern too long")
        .when(c("pattern").rlike(r"\(\?=|\(\?!|\(\?<|\\1|\\2"), "unsupported construct")
        .when(F.startswith(c("pattern"), F.lit(".*")), "leading wildcard")
    )
    marked = detectors.withColumn("reason", reason)
    names = (
        marked.filter("reason is null").groupBy("name").agg(F.count("*").alias("_n"))
        .filter("_n > 1")
    )
    return (
        marked.join(names, "name", "left")
        .withColumn(
            "reason",
            F.coalesce("reason", F.when(c("_n").isNotNull(), F.lit("duplicate name"))),
        )
        .withColumn("valid", c("reason").isNull())
        .drop("_n")
    )


def key_names(
    features: DataFrame, tenant: str = "tenant_id", top: int | None = 40,
    longest: int | None = None,
) -> DataFrame:
    """The ``top`` field names per tenant (None: all); counts are aggregated before ranking."""
    name = F.lower(F.trim("key_name"))
    counts = (
        features.select(tenant, name.alias("key_name"))
        .filter((F.col("key_name") != "") & (F.col("key_name") != "«opaque»"))
        .filter(F.lit(True) if longest is None else F.length("key_name") <= longest)
        .groupBy(tenant, "key_name").agg(F.count("*").alias("n"))
    )
    rank = F.row_number().over(W.partitionBy(tenant).orderBy(F.desc("n"), "key_name"))
    ranked = counts.withColumn("rank", rank)
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def deployment_profile(rules: DataFrame, tenant: str = "tenant_id") -> DataFrame:
    """Classes a tenant's rules name. ``rules`` is the exploded rule table."""
    return (
        rules.select(tenant, F.explode("class").alias("entity_class")).distinct()
    )


def propose_checks(features: DataFrame) -> DataFrame:
    """Deterministic proposal for spans whose shape looks structured."""
    structured = F.col("shape").rlike("[-_]") & F.col("charset").isin("ascii", "base64ish")
    return features.withColumns(
        {
            "verdict_hint": F.when(structured, "sensitive").otherwise("unknown"),
            "proposal_confidence": F.when(structured, 0.6).otherwise(0.3),
            "rationale": F.when(
                structured,
                F.concat(F.lit("recurring structured shape '"), F.col("shape"),
                         F.lit("' under key '"), F.col("key_name"), F.lit("'")),
            ),
        }
    )


def baseline_rules(spark: SparkSession, rules: Sequence[LearnedRule]) -> DataFrame:
    return spark.createDataFrame(
        [
            (r.entity_class, r.rationale, list(r.anchors), r.pattern, r.min_len, r.max_len,
             r.charset, list(r.context), r.checksum, r.confidence, r.support)
            for r in rules
        ],
        RULE_SCHEMA,
    )


# Two rules that fit plain business text.
EMAIL_RULE = LearnedRule(
    "EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", min_len=6, max_len=254,
    confidence=0.6, needs="@",
)
CARD_RULE = LearnedRule(
    "CREDIT_CARD", r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}", min_len=13,
    max_len=23, checksum="luhn", confidence=0.6,
)
TEXT_RULES = (EMAIL_RULE, CARD_RULE)
