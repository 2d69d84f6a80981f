"""Secret scan: candidate spans, then corpus-wide ownership of each candidate's value.

Patterns find candidates with their places in code points. Values are hashed and counted by distinct
owners and repositories over the whole corpus: one that many owners hold is a copied example, one
that few hold and that does not look like a placeholder is live. Base spans always stay; the spans
of further patterns are added where they are live and not inside a base span. DataFrame functions
only. The candidate table (no texts) is written once; counts are pre-aggregated by (value, owner),
and the copied values are salted when joined back, so a value in a third of all rows is spread.

Cases: a null text is empty and has no spans; null owners count as one owner; repeated rows are
scanned each; an empty table gives no rows; other columns are ignored (``mask_secrets`` keeps them).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, own_names

#: Kind, pattern, group that holds the value, its least length.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
# A private key: its header, then all up to its END line if nothing but key text stands between, else the
# block of base64 runs that follows. Line breaks may be escaped, quoted or marked as in source code.
_HEADER, _FOOTER = (rf"-----{x} [A-Z0-9\x20]{{0,30}}PRIVATE KEY(?: BLOCK)?-----" for x in ("BEGIN", "END"))
_BREAK = r"""(?:\\+[nrt]|[\s"'+,.<>&;%#*|\\])"""
_FIELD = (r"(?:Proc-Type:\x20?4,ENCRYPTED|DEK-Info:\x20?[A-Z0-9-]+,[0-9A-Fa-f]+|"
          r"(?:Version|Comment|Charset|Hash|MessageID):[^\r\n\\]*+)")
_RUN = r"[A-Za-z0-9+/]{16,}+={0,2}"
_LAST = (rf"(?:(?=[^A-Za-z0-9]*(?:\n|\\n)){_BREAK}++[A-Za-z0-9+/]++={{0,2}}(?=[\x20\t\"',;+]*(?:[\r\n\\<]|-----|$))|"
         rf"{_BREAK}++[A-Za-z0-9+/]++={{1,2}})?")  # a shorter last line
_KEY = (rf"""{_HEADER}((?:{_BREAK}*+(?:{_FIELD}{_BREAK}*+)*+(?:[A-Za-z0-9+/=\s"'\\,<>&;%#*|]*+(?={_FOOTER})|"""
        rf"""{_RUN}(?:{_BREAK}++{_RUN})*+{_LAST}))?)(?:{_BREAK}*+{_FOOTER})?""")
#: Further kinds of credentials.
MORE = [
    ("key", _KEY, 1, 27),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", 0, 27),
    ("bearer", r"(?i)bearer\x20+([A-Za-z0-9._~+/-]{20,})", 1, 20),
    ("vendor", r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza)[A-Za-z0-9_-]{16,}", 0, 20),
    ("login", r"://[^\s/:@]++:([^\s/:@]{6,}+)@", 1, 6),
]
# A placeholder's word begins the value or follows a sign, and no letter but a plain noun follows it, so a random
# value that merely holds its letters is not one; a run of digits or one repeated sign must be most of the value.
_STUB = (r"(?<![a-z0-9])(?:example|sample|dummy|changeme|placeholder|test(?:ing)?|fake|todo|redacted|foobar|your|my|insert|replace)"
         r"(?:key|token|secret|password|value|user)?(?![a-z])")
_PLACEHOLDER = rf"(?i){_STUB}|example$|change_?me|place_?holder|x{{4}}|^(.)\1*$|^\D{{0,4}}(?:0?123456(?:7(?:89?)?)?0?)\D{{0,4}}$|^(?:pass|secret|admin|qwerty)(?:word)?\d{{0,4}}$"
_LONG_PLACEHOLDER = rf"(?i){_STUB}.{{0,40}}{_STUB}|x{{8}}|^(.)\1*$|0123456789"  # rare in random key text
LEAST_ENTROPY = 0.9  # bits a sign, of the first signs: below it nearly all of them are one sign
SPAN = "array<struct<start:int,kind:int,end:int,value:bigint,plain:boolean>>"


def value_of(match: Column, pattern: str, group: int, least: int) -> Column:
    """The value of a match. A private key's is its key text without fields and line breaks, or its
    header where no key text follows."""
    if pattern != _KEY:
        return F.regexp_extract(match, pattern, group) if group else match
    body = F.regexp_replace(F.regexp_extract(match, pattern, group), rf"{_FIELD}|\\+[nrt]|[^A-Za-z0-9+/=]", "")
    return F.when(F.length(body) >= least, body).otherwise(F.regexp_extract(match, _HEADER, 0))


def entropy(value: Column) -> Column:
    """Bits a sign among the first 64 signs."""
    signs = F.split(F.substring(value, 1, 64), "")

    def bits(x):
        counts = F.transform(F.array_distinct(x), lambda c: F.size(F.filter(x, lambda y: y == c)))
        n = F.size(x)
        return F.aggregate(counts, F.lit(0.0), lambda a, k: a - (k / n) * F.log2(k / n))

    return let(F.filter(signs, lambda c: c != ""), bits)


def is_plain(value: Column, pattern: str) -> Column:
    """Whether a value looks like a placeholder."""
    plain = value.rlike(_PLACEHOLDER) | (entropy(value) < LEAST_ENTROPY)
    return F.when(F.length(value) >= 64, value.rlike(_LONG_PLACEHOLDER)).otherwise(plain) if pattern == _KEY else plain


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What all elements before each come to under ``step`` (from 0), for an array of integers. Groups of about
    the square root of its length are summed up first, so long arrays take few steps an element."""

    def total(x):
        return F.aggregate(x, F.lit(0), step)

    def by_group(v):
        width = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        last = F.greatest(F.ceil(F.size(v) / width).cast("int") - 1, F.lit(0))
        groups = F.transform(F.sequence(F.lit(0), last), lambda g: total(F.slice(v, g * width + 1, width)))

        def inside(found):
            return F.flatten(F.transform(found, lambda whole, g: let(F.slice(v, g * width + 1, width), lambda own: let(
                total(F.slice(found, F.lit(1), g)), lambda before: F.transform(own, lambda x, i: F.aggregate(F.slice(own, F.lit(1), i), before, step))))))

        return let(groups, inside)

    return F.when(F.size(values) > 0, let(values, by_group)).otherwise(F.array().cast("array<int>"))


def cut(text: Column, parts: Column) -> Column:
    """The texts of ``parts`` (structs of ``from`` and ``to``, in order and apart). Finding a place takes a walk
    from the beginning, so parts are cut out of the text by groups and then apart."""

    def by_group(p):
        width = F.greatest(F.ceil(F.sqrt(F.size(p))).cast("int"), F.lit(1))
        last = F.greatest(F.ceil(F.size(p) / width).cast("int") - 1, F.lit(0))

        def group(g):
            return let(F.slice(p, g * width + 1, width), lambda own: let(F.element_at(own, 1)["from"], lambda begin: let(
                F.substring(text, begin + 1, F.element_at(own, -1)["to"] - begin),
                lambda piece: F.transform(own, lambda x: F.substring(piece, x["from"] - begin + 1, x["to"] - x["from"])))))

        return F.flatten(F.transform(F.sequence(F.lit(0), last), group))

    return let(parts, by_group)


def spans_of(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches with their places: the text between matches (``split``) and
    the matches themselves alternate, so places are running sums of their lengths."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    pairs = F.filter(pairs, lambda p: p["match"].isNotNull())

    def spans(pairs):
        before = running(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["match"])), lambda a, b: a + b)

        def one(p, begin):
            start = begin + F.length(p["gap"])
            return let(value_of(p["match"], pattern, group, least), lambda value: F.when(F.length(value) >= least, F.struct(
                start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(p["match"])).alias("end"),
                F.xxhash64(value).alias("value"), is_plain(value, pattern).alias("plain"))))

        return let(before, lambda b: F.transform(pairs, lambda p, i: one(p, F.get(b, i))))

    found = F.filter(let(pairs, spans), lambda s: s.isNotNull())
    return F.when(text.rlike(pattern), found.cast(SPAN)).otherwise(F.array().cast(SPAN))


def candidate_spans(text: Column) -> Column:
    """All candidates of a text, by start and kind; further kinds inside a base span are left out: of spans in
    order of place, longer ones first, one lies inside a base span if a base span before it ends there or later."""
    base = F.concat(*[spans_of(text, k, *rest[1:]) for k, rest in enumerate(BASE)])
    hint = "|".join(p.replace("(?i)", "") for _, p, _, _ in MORE)
    more = F.concat(*[spans_of(text, len(BASE) + k, *rest[1:]) for k, rest in enumerate(MORE)])

    def outside(base, more):
        by_place = F.array_sort(F.transform(F.concat(base, more), lambda s: F.struct(
            s["start"].alias("at"), (-s["end"]).alias("shorter"), s["kind"].alias("kind"), s.alias("span"))))

        def apart(found):
            ends = F.transform(found, lambda f: F.when(f["kind"] < len(BASE), f["span"]["end"]).otherwise(F.lit(0)))
            return let(running(ends, lambda a, b: F.greatest(a, b)), lambda to: F.filter(found, lambda f, i: (f["kind"] < len(BASE)) | (
                F.get(to, i) < f["span"]["end"])))

        return F.transform(let(by_place, apart), lambda f: f["span"])

    return let(base, lambda b: F.array_sort(F.when(text.rlike(f"(?i){hint}"), let(more, lambda m: F.when(
        (F.size(b) > 0) & (F.size(m) > 0), outside(b, m)).otherwise(F.concat(b, m)))).otherwise(b)))


def candidates(docs: DataFrame, owner_col: str, repo_cols: tuple[str, ...]) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"),
        F.xxhash64(owner_col).alias("owner"), F.xxhash64(*repo_cols).alias("repo"), candidate_spans(text).alias("spans"))
    return rows


def find_secrets(docs: DataFrame, owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"),
                 copied_owners: int = 3, copied_repos: int = 6, salts: int = 16) -> DataFrame:
    """One row per document: ``doc_id``, ``text_hash`` and ``spans`` (by start, then kind), each with
    ``live``. A value is copied from ``copied_owners`` distinct owners or ``copied_repos`` distinct
    repositories on."""
    scratch = Scratch(docs.sparkSession, "secrets")
    found = scratch.table(candidates(docs, owner_col, repo_cols), "candidates")
    each = found.select("row", "owner", "repo", F.explode("spans").alias("span"))
    copied = each.groupBy(F.col("span.value").alias("copied")).agg(
        F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repos")).where(
        (F.col("owners") >= copied_owners) | (F.col("repos") >= copied_repos))
    salted = copied.select("copied", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    spans = each.select("row", "span", F.pmod("row", F.lit(salts)).cast("int").alias("own_salt")).join(
        salted, (F.col("span.value") == F.col("copied")) & (F.col("own_salt") == F.col("salt")), "left")
    live = F.col("copied").isNull() & ~F.col("span.plain")
    judged = spans.select("row", F.struct(
        F.col("span.start").alias("start"), F.col("span.kind").alias("kind"), F.col("span.end").alias("end"), live.alias("live")).alias("span"))
    kept = judged.where(F.col("span.live") | (F.col("span.kind") < len(BASE)))
    by_row = kept.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    empty = F.array().cast(by_row.schema["spans"].dataType)
    return found.drop("spans", "owner", "repo").join(by_row, "row", "left").select(
        "doc_id", "text_hash", F.coalesce("spans", empty).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in [*BASE, *MORE]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans per document; ``n_live`` and ``n_copied`` over all its spans."""
    found = find_secrets(docs)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{BASE[k][0]}")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    n_live = F.size(F.filter("spans", lambda s: s["live"])).cast("long")
    return found.select(
        "doc_id", *[count(k) for k in range(len(BASE))], F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"), n_live.alias("n_live"), (F.size("spans") - n_live).alias("n_copied"))


def mask_secrets(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """All documents; live spans become ``mask`` (``n_chars`` follows). Widely copied values stay."""
    own_id, own_hash, own_spans = own_names("id", "hash", "spans")
    spans = find_secrets(docs).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash),
                                      F.filter("spans", lambda s: s["live"]).alias(own_spans)).where(F.size(own_spans) > 0)
    spans = Scratch(docs.sparkSession, "secret-spans").table(spans.dropDuplicates([own_id, own_hash]), "spans")
    same = spans[own_id].eqNullSafe(docs["doc_id"]) & (spans[own_hash] == F.xxhash64(docs["text"]))
    text = docs["text"]

    def kept(found):
        """The text between the spans; overlapping ones are one."""
        to = running(F.transform(found, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        gaps = let(to, lambda t: F.transform(found, lambda s, i: F.struct(F.get(t, i).alias("from"), s["start"].alias("to"))))
        last = F.struct(F.array_max(F.transform(found, lambda s: s["end"])).alias("from"), F.length(text).alias("to"))
        return cut(text, F.concat(F.filter(gaps, lambda g: g["to"] >= g["from"]), F.array(last)))

    masked = F.array_join(kept(spans[own_spans]), mask)
    joined = docs.join(spans, same, "left")
    new_text = F.when(spans[own_spans].isNull(), text).otherwise(masked)
    columns = [new_text.alias(c) if c == "text" else
               F.when(spans[own_spans].isNull(), docs[c]).otherwise(F.length(masked)).cast(docs.schema[c].dataType).alias(c)
               if c == "n_chars" else docs[c] for c in docs.columns]
    return joined.select(*columns)
