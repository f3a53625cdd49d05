"""Secret scan with corpus-wide ownership: how many repositories and owners hold a candidate tells examples from live keys.

Each candidate's value is hashed; distinct (value, owner, repository) triples are counted per owner and then per value,
with partial sums before each shuffle, so a value that a third of all documents hold is no hot spot. A value that more
than `most_owners` owners hold is a widely copied example; others look live. The contract's kinds always stand and are
labelled; the added kinds (provider tokens, signed web tokens, key blocks) count only where they look live.

Defined cases: a null text counts as empty; a null owner or repository is one owner or repository of its own. Repeated
rows count once for ownership and are each reported. Long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm._common import documents, materialize, row_key, spread_join
from parley.llm.spans import listed, spans

# Fixed values of the contract.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
# Added kinds.
PROVIDER = r"(?:gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{20,}+|sk_live_[A-Za-z0-9]{16,}+)"
SIGNED = r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
KEY_BLOCK = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"

BASE = ("assign", "access", "hex")
ADDED = ("provider", "signed", "key_block")


def candidates(text: Column) -> dict[str, Column]:
    """Spans of each kind; `part` is the value that owners may share."""
    return {
        "assign": F.filter(spans(text, ASSIGN, F.lower(text).rlike("pass|secret|token|key"), group=1), lambda s: F.length(s["part"]) >= 6),
        "access": spans(text, ACCESS, text.contains("AKIA")),
        "hex": spans(text, HEX),
        "provider": spans(text, PROVIDER),
        "signed": spans(text, SIGNED, text.contains("eyJ")),
        "key_block": spans(text, KEY_BLOCK, text.contains("PRIVATE KEY")),
    }


def ownership(cands: DataFrame) -> DataFrame:
    """value, owners, repositories from rows of (value, owner, repo). Hot values are summed before every shuffle."""
    per_owner = cands.select("value", "owner", "repo").distinct().groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"))
    return per_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, most_owners: int = 2) -> DataFrame:
    """doc_id, cands: array<struct<kind, start, end, value, owners, repositories, live>> for each row of docs.

    value: 64 bits of the candidate's SHA-256 in hex, so that no secret leaves the text. repo_col: the id by default.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = documents(docs, id_col, text_col, owner=owner_col, repo=repo_col or id_col)
    one = lambda k: lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.substring(F.sha2(s["part"], 256), 1, 16).alias("value"))
    cands = F.concat(*(F.transform(c, one(k)) for k, c in candidates(text).items()))
    rows = materialize(raw.select("doc_id", row_key(F.col("text")).alias("rk"), "owner", "repo", cands.alias("cands")), "secret-candidates")
    flat = rows.where("size(cands) > 0").select("doc_id", "rk", "owner", "repo", F.inline("cands"))
    known = materialize(ownership(flat).withColumn("n", F.col("repositories")), "secret-owners")
    # an example that everyone copies is a value of very many rows
    told = spread_join(flat.select("doc_id", "rk", "kind", "start", "end", "value"), known, ["value"], flat.count(), "n").distinct()
    told = told.withColumn("live", F.col("owners") <= most_owners)
    mine = told.groupBy(F.col("doc_id").alias("__i"), F.col("rk").alias("__k")).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "value", "owners", "repositories", "live"))).alias("cands"))
    on = F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("rk") == F.col("__k"))
    none = F.array().cast(mine.schema["cands"].dataType)
    return rows.select("doc_id", "rk").join(mine, on, "left").select("doc_id", F.coalesce("cands", none).alias("cands"))


def digest(rows: DataFrame) -> DataFrame:
    """The contract's columns from what scan_secrets() returns."""
    of = lambda *kinds: F.filter("cands", lambda c: c["kind"].isin(*kinds))
    base = [(k, of(k)) for k in BASE]
    live_of = lambda kind: F.filter("cands", lambda c: (c["kind"] == kind) & c["live"])
    added = [(k, live_of(k)) for k in ADDED]
    return rows.select(
        "doc_id",
        *(F.size(c).cast("long").alias(f"n_{k}") for k, c in base),
        F.sha2(listed(base, by_start=True), 256).alias("base_sha256"),
        listed([*base, *added], by_start=True).alias("spans"),
        F.size(F.filter("cands", lambda c: c["live"])).cast("long").alias("n_live"),
        F.size(F.filter("cands", lambda c: ~c["live"])).cast("long").alias("n_example"),
    )
