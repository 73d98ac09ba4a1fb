"""Secrets in texts, told apart by how widely their values are owned.

Candidates are found in the whole text: the three base kinds, and further kinds that only count if
they look live. The values' hashes are counted over the whole corpus by distinct repositories and
owners (counts per hash and owner first, so a value in a third of all rows is added up before it is
shuffled). A value of ``WIDE_OWNERS`` owners or more is a widely copied example; one of fewer owners
that is no placeholder and varied enough looks live.

Defined results
* null text: no span. Null owners count as one owner of their own, null repositories likewise.
* Spans are in code points, end exclusive; per kind they don't overlap, kinds may overlap each other.
  An assignment's span is the whole match, its value the part after the sign.
* Repeated rows each get the same findings and count once as repository. Empty table: empty result.
* Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from haptrace.session import cut_lineage

WIDE_OWNERS = 3
# Values in so many repositories are copied examples too, if all of one owner.
WIDE_REPOSITORIES = 50
MIN_ENTROPY = 2.5
BASE = ("assign", "access", "hex")
ADDED = ("bearer", "jwt", "pem", "opaque")
KINDS = BASE + ADDED
LONG_WORD = 24

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}

BEARER = re.compile(r"Bearer\x20+([A-Za-z0-9._~+/-]{16,}=*)")
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
# Headers of encrypted keys hold hyphens, so the body runs to the END line, but never into another key.
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----(?:(?!-----BEGIN ).)+?-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----", re.DOTALL)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your|test|xxxx|0000|1234|abcd|password", re.IGNORECASE)


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) if n else 0.0


def plausible(value: str) -> bool:
    return entropy(value) >= MIN_ENTROPY and not PLACEHOLDER.search(value)


def candidates(text: str | None) -> list[tuple[int, int, int, str]]:
    """(number of the kind, start, end, value), ascending by start, then kind."""
    text = text or ""
    found = []
    lower = text.lower()
    # The words that a pattern needs are looked for first; most texts have none.
    if any(w in lower for w in ("passw", "secret", "token", "api")):
        found += [(0, *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(1, *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if any(len(w) >= LONG_WORD for w in text.split()):
        found += [(2, *m.span(), m[0]) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
        found += [(6, *m.span(), m[0]) for m in OPAQUE.finditer(text) if _mixed(m[0])]
    if "Bearer" in text:
        found += [(3, *m.span(), m[1]) for m in BEARER.finditer(text)]
    if "eyJ" in text:
        found += [(4, *m.span(), m[0]) for m in JWT.finditer(text)]
    if "PRIVATE KEY" in text:
        found += [(5, *m.span(), m[0]) for m in PEM.finditer(text)]
    return sorted(found, key=lambda f: (f[1], f[0]))


def _mixed(value: str) -> bool:
    return bool(re.search("[a-z]", value) and re.search("[A-Z]", value) and re.search("[0-9]", value))


SPANS = "array<struct<kind:int,start:int,end:int,hash:string,plausible:boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string()), ("plausible", pa.bool_())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None) -> DataFrame:
    """(id, owner, repository, spans): a document is its own repository if no column names one."""
    repository = F.col(repository_col or id_col).cast("string")
    picked = docs.select(F.col(id_col).alias("id"), F.col(owner_col).cast("string").alias("owner"), repository.alias("repository"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest(), "plausible": plausible(v)}
                 for k, s, e, v in candidates(text.as_py())] for text in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, _ARROW)], names=["id", "owner", "repository", "spans"])

    return picked.mapInArrow(run, f"id {kind}, owner string, repository string, spans {SPANS}")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories) of all candidates; null is an owner, and a repository, of its own."""
    seen = found.select(F.explode("spans.hash").alias("hash"), "owner", "repository").distinct()
    by_owner = seen.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None,
                 wide_owners: int = WIDE_OWNERS, wide_repositories: int = WIDE_REPOSITORIES) -> DataFrame:
    """(id, findings): structs of kind, start, end, owners, repositories, live, ascending by start and kind.

    Base kinds are all listed; further kinds only where they look live.
    """
    found = cut_lineage(scan(docs, id_col, text_col, owner_col, repository_col).withColumn("row", F.monotonically_increasing_id()))
    counts = cut_lineage(ownership(found))
    spans = found.select("row", F.explode("spans").alias("s")).select("row", "s.*").join(counts, "hash")
    live = F.col("plausible") & (F.col("owners") < wide_owners) & (F.col("repositories") < wide_repositories)
    judged = spans.withColumn("live", live).filter(F.col("live") | (F.col("kind") < len(BASE)))
    listed = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "owners", "repositories", "live"))).alias("f"))
    name = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform("f", lambda x: F.struct(
        name[x["kind"]].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["owners"].alias("owners"),
        x["repositories"].alias("repositories"), x["live"].alias("live")))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,owners:bigint,repositories:bigint,live:boolean>>")
    return found.select("row", "id").join(listed, "row", "left").select(F.col("id").alias(id_col), F.coalesce(named, empty).alias("findings"))


def joined(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def of_kinds(findings: Column, *kinds: str) -> Column:
    return F.filter(findings, lambda x: x["kind"].isin(*kinds))
