"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Three base kinds of spans are found by pattern; three further kinds (CANDIDATES)
are proposed. Every value found is hashed, and the hashes are counted over the
corpus by distinct repositories and owners. A value of at most MOST_OWNERS owners
and MOST_REPOSITORIES repositories looks like somebody's credential; one that
more have was copied from an example. Proposed spans are added if their value is
live-looking; base spans always stay and carry the verdict.

A match starts after the pieces and matches before it: their lengths are summed
over the matches of a row and kind, so a text with very many matches costs a sort
of them. All offsets are code points, ends exclusive.

Defined cases: null and empty texts have no spans; a null owner or repository is
one owner or repository; repeated rows count their owner once; verdicts belong to
rows, so rows without doc_id, or of one doc_id with different texts, have each
their own; texts of any length are scanned whole; other columns are carried and
never read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import settle

#: Kind, what makes a row worth scanning, pattern. Matches of assign with a short value are dropped.
_NAME = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
_LEAD = _NAME + "[\"']?\\x20*[:=]\\x20*[\"']?"
ASSIGN = _LEAD + "[A-Za-z0-9+/_.=-]+"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
CANDIDATES = (
    ("bearer", "[bB]earer\\x20+[A-Za-z0-9._~+/-]{16,}", "^[bB]earer\\x20+"),
    ("prefixed", "(?:gh[pousr]_|xox[abps]-|sk_live_|glpat-)[A-Za-z0-9_-]{16,}", "^$"),
    ("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", "^$"),
)
KINDS = ("assign", "access", "hex", *(k for k, _, _ in CANDIDATES))
BASE_KINDS = 3
#: A value of more owners or of more repositories is taken for a copied example.
MOST_OWNERS, MOST_REPOSITORIES = 3, 8


_MATCH = "kind:int,nth:int,gap:int,n:int,gap_bytes:int,n_bytes:int,value_n:int,hash:string"


def _found(text: Column, pattern: str, kind: str, lead: str, when: Column) -> Column:
    """The leftmost matches that don't overlap: the text between them in code points and bytes, their own lengths, the value."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def match(x: Column, nth: Column) -> Column:
        value = F.regexp_replace(x["match"], lead, "")
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            nth.alias("nth"),
            F.length(x["piece"]).alias("gap"),
            F.length(x["match"]).alias("n"),
            F.octet_length(x["piece"]).alias("gap_bytes"),
            F.octet_length(x["match"]).alias("n_bytes"),
            F.length(value).alias("value_n"),
            F.sha2(value, 256).alias("hash"),
        )

    both = F.filter(F.arrays_zip(pieces.alias("piece"), matches.alias("match")), lambda x: x["match"].isNotNull())
    none = F.expr(f"cast(array() as array<struct<{_MATCH}>>)")
    return F.when(when, F.transform(both, match)).otherwise(none)


def _matches(text: Column) -> Column:
    """All matches of all kinds in one array."""
    found = [
        _found(text, ASSIGN, "assign", "^" + _LEAD, (text.contains(":") | text.contains("=")) & text.rlike(_LEAD)),
        _found(text, ACCESS, "access", "^$", text.contains("AKIA")),
        _found(text, HEX, "hex", "^$", text.rlike(HEX)),
    ]
    found += [_found(text, pattern, kind, lead, text.rlike(pattern)) for kind, pattern, lead in CANDIDATES]
    return F.concat(*found)


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def value_owners(values: DataFrame) -> DataFrame:
    """(hash, owners, repositories) of values(hash, owner, repository): distinct owners and repositories."""
    seen = values.select("hash", "owner", "repository").distinct()
    per_owner = seen.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    # An owner's repositories are known by owner and name, so counts add up.
    return per_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def secret_scan(
    documents: DataFrame,
    owner: Column,
    repository: Column,
    carried: list[str] | None = None,
    most_owners: int = MOST_OWNERS,
    most_repositories: int = MOST_REPOSITORIES,
) -> DataFrame:
    """Spans of every row of documents(text, ...).

    (doc, spans, cuts, last): doc holds the carried columns (all, if none are
    named); spans are (start, kind, end, live), ordered, without the proposed ones
    that aren't live; cuts are the byte ranges before each live span that are not
    part of another one, last the byte at which the last live span ends.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = settle(
        documents.select(
            F.monotonically_increasing_id().alias("row"),
            F.struct(*[F.col(f"`{c}`") for c in carried or documents.columns]).alias("doc"),
            F.coalesce(owner, F.lit("")).alias("owner"),
            F.coalesce(repository, F.lit("")).alias("repository"),
            _matches(text).alias("found"),
        )
    )
    matches = scanned.where("size(found) > 0").select("row", "owner", "repository", F.inline("found"))
    own = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    spans = (
        matches.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(own).cast("int"))
        .withColumn("end_byte", F.sum(F.col("gap_bytes") + F.col("n_bytes")).over(own).cast("int"))
        .where(f"kind != {KINDS.index('assign')} or value_n >= 8")
        .withColumn("start", F.col("end") - F.col("n"))
        .withColumn("start_byte", F.col("end_byte") - F.col("n_bytes"))
    )
    spans = settle(spans.select("row", "owner", "repository", "kind", "start", "end", "start_byte", "end_byte", "hash"))
    count = value_owners(spans)
    live = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    spans = spans.join(count.select("hash", live.alias("live")), "hash").where(f"live or kind < {BASE_KINDS}")
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("from", F.coalesce(F.max(F.when(F.col("live"), F.col("end_byte"))).over(before), F.lit(0)))
    cut = F.when(F.col("live") & (F.col("start_byte") >= F.col("from")), F.struct(F.col("start_byte").alias("upto"), "from"))
    verdicts = spans.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("spans"),
        F.sort_array(F.collect_list(cut)).alias("cuts"),
        F.max(F.when(F.col("live"), F.col("end_byte"))).alias("last"),
    )
    # Only rows with a match take part in the join; most rows have none.
    some = scanned.where("size(found) > 0").select("row", "doc").join(verdicts, "row", "left")
    none = scanned.where("size(found) = 0").select("row", "doc").withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in verdicts.schema if f.name != "row"}
    )
    out = some.unionByName(none)
    empty = [F.coalesce(c, F.array().cast(verdicts.schema[c].dataType)).alias(c) for c in ("spans", "cuts")]
    return out.select("doc", *empty, "last")


def secret_report(found: DataFrame) -> DataFrame:
    """The digest columns of secret_scan()'s rows, of which doc_id is carried."""
    base = F.filter("spans", lambda x: x["kind"] < BASE_KINDS)

    def of_kind(k: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return found.select(
        "doc.doc_id",
        *[of_kind(k) for k in range(BASE_KINDS)],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["kind"] >= BASE_KINDS)).cast("long").alias("n_added"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"),
    )


def without_live_secrets(documents: DataFrame, owner: Column, repository: Column, mask: str = "[SECRET]") -> DataFrame:
    """The documents with the spans of live-looking values replaced by the mask; copied examples stay."""
    found = secret_scan(documents, owner, repository)

    def masked(raw: Column) -> Column:
        kept = F.transform("cuts", lambda c: F.concat(F.substring(raw, c["from"] + 1, c["upto"] - c["from"]).cast("string"), F.lit(mask)))
        return F.concat(F.array_join(kept, ""), F.substring(raw, F.col("last") + 1, F.octet_length(raw)).cast("string"))

    # The lambda takes the text's bytes once, not once a span.
    text = F.get(F.transform(F.array(F.encode("doc.text", "UTF-8")), masked), F.lit(0))
    new = {"text": F.when(F.col("last").isNotNull(), text).otherwise(F.col("doc.text"))}
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("last").isNotNull(), F.length(text).cast(kind)).otherwise(F.col("doc.n_chars"))
    return found.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in documents.columns])
