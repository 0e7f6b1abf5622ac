"""Secret scans with linking of multipart credentials, in DataFrame functions only.

Base spans come from three fixed patterns. Weaker parts (account names, long
mixed tokens, endpoints) are reported only when complementary parts stand in the
same scope: an interval join on buckets of ``SCOPE`` code points finds for each
part the others at most ``SCOPE`` away in its document.

Edge cases: a null text is empty; empty texts and documents without spans give
zero counts, the digest of the empty string and an empty list; repeated rows
each get the result of their text; null ids are kept; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.llm.shared import drop_written, written

SCOPE = 240
LEAST_VALUE = 8

#: Fixed patterns of the base kinds. Runs that are too short are left out by their
#: length, which for the last two can stand in the pattern.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{12,})"
HEX = r"([0-9a-f]{32,})"
BASE = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
#: Weaker parts, which count only beside their complements.
USER = r"""(?:[uU][sS][eE][rR](?:[nN][aA][mM][eE])?|[lL][oO][gG][iI][nN]|[aA][cC][cC][oO][uU][nN][tT]|[cC][lL][iI][eE][nN][tT]_?[iI][dD])["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})"""
KEY = r"((?:[A-Za-z]+[0-9]|[0-9]+[A-Za-z])[A-Za-z0-9+/=_-]{18,})"
#: The same matches: a run of letters or digits is read once, from its start, as later starts in it can't do better.
KEY_ONCE = r"((?:(?<![A-Za-z])[A-Za-z]++[0-9]|(?<![0-9])[0-9]++[A-Za-z])[A-Za-z0-9+/=_-]{18,}+)"
ENDPOINT = r"""((?:https?|ftps?|sftp|ssh|s3|gs|redis|amqps?|mongodb|mysql|postgres(?:ql)?|wss?)://[^\x00-\x20"'<>]+)"""
WEAK = {"user": USER, "key": KEY, "endpoint": ENDPOINT}
ROLE = {"access": "id", "user": "id", "assign": "secret", "hex": "secret", "key": "secret", "endpoint": "endpoint"}
KINDS = [*BASE, *WEAK]
SPANS = "array<struct<s:int,o:int,e:int,kind:string>>"
#: Matches whose positions are added up together.
CHUNK = 512


def spans(text: Column, pattern: str, kind: str, least: int = 0) -> Column:
    """Leftmost matches that don't overlap, with code point positions: array<struct<s, o, e, kind>>.

    The pieces between matches and the matches themselves add up to positions, in chunks of ``CHUNK``, so that
    long lists are not copied at every match.
    """
    pieces = F.slice(F.split(text, pattern, -1), 1, 1_000_000_000)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    lengths = F.transform(F.arrays_zip(pieces.alias("p"), found.alias("m"), value.alias("v")), lambda x: F.struct(F.length(x["p"]).alias("p"), F.coalesce(F.length(x["m"]), F.lit(0)).alias("m"), F.coalesce(F.length(x["v"]), F.lit(-1)).alias("v")))
    one = lambda s, m: F.struct(s.cast("int").alias("s"), F.lit(KINDS.index(kind)).alias("o"), (s + m).cast("int").alias("e"), F.lit(kind).alias("kind"))
    none = F.array().cast(SPANS)
    step = lambda a, x: F.struct((a["at"] + x["p"] + x["m"]).alias("at"), F.when(x["v"] >= least, F.concat(a["got"], F.array(one(a["at"] + x["p"], x["m"])))).otherwise(a["got"]).alias("got"))
    few = lambda at, chunk: F.aggregate(chunk, F.struct(at.alias("at"), none.alias("got")), step)
    # the list of one chunk stands for it, so that it is added up once
    joined = lambda a, chunk: F.get(F.transform(F.array(few(a["at"], chunk)), lambda c: F.struct(c["at"].alias("at"), F.concat(a["got"], F.array(c["got"])).alias("got"))), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("got"))

    def added(all_: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda i: F.slice(all_, i * CHUNK + 1, F.lit(CHUNK)))
        return F.flatten(F.aggregate(chunks, start, joined, lambda a: a["got"]))

    # the lengths are an array of one list, so that they are taken once
    return F.when(F.regexp_like(text, F.lit(pattern)), F.get(F.transform(F.array(lengths), added), F.lit(0))).otherwise(none)


def parts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, _h, _base, _weak): all parts of each text; weak ones only of texts that hold an identifier."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(*[spans(text, p, k, LEAST_VALUE if k == "assign" else 0) for k, p in BASE.items()])
    has_id = F.regexp_like(text, F.lit(ACCESS)) | F.regexp_like(text, F.lit(USER))
    weak = F.when(has_id, F.concat(*[spans(text, KEY_ONCE if p == KEY else p, k) for k, p in WEAK.items()])).otherwise(F.array().cast(SPANS))
    return docs.select("doc_id", F.xxhash64(text).alias("_h"), base.alias("_base"), weak.alias("_weak"))


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, _h, extra): weak parts that have their complements within ``scope``.

    A weak secret needs an identifier, a weak identifier needs a secret, and an
    endpoint needs both. Weak parts inside base spans don't count. Repeated rows are joined once.
    """
    apart = F.filter("_weak", lambda w: ~F.exists("_base", lambda b: (w["s"] < b["e"]) & (b["s"] < w["e"])))
    role = F.when(F.col("p.kind").isin("access", "user"), "id").when(F.col("p.kind") == "endpoint", "endpoint").otherwise("secret")
    parts = parts.where(F.size("_weak") > 0).select("doc_id", "_h", F.explode(F.concat("_base", apart)).alias("p"))
    parts = parts.select("doc_id", "_h", "p", role.alias("role"), F.floor(F.col("p.s") / scope).alias("bucket")).distinct()
    near = parts.where("role != 'endpoint'").select("doc_id", "_h", F.col("p.s").alias("s"), F.col("p.e").alias("e"), F.col("role").alias("other"), F.explode(F.array(*[F.col("bucket") + d for d in (-1, 0, 1)])).alias("bucket"))
    at = parts.where(F.col("p.o") >= len(BASE))
    pairs = at.alias("a").join(near.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a._h") == F.col("b._h")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.abs(F.col("a.p.s") - F.col("b.s")) <= scope) & (F.col("a.role") != F.col("b.other")) & ((F.col("a.p.e") <= F.col("b.s")) | (F.col("b.e") <= F.col("a.p.s"))))
    has = pairs.groupBy("a.doc_id", "a._h", "a.p", "a.role").agg(F.max(F.col("b.other") == "id").alias("ids"), F.max(F.col("b.other") == "secret").alias("secrets"))
    kept = has.where(((F.col("role") != "endpoint") & (F.col("ids") | F.col("secrets"))) | (F.col("ids") & F.col("secrets")))
    return kept.groupBy("doc_id", "_h").agg(F.collect_list("p").alias("extra"))


def listed(found: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: counts and digest of base spans, and all spans. Texts are searched once; only positions are written for what follows."""
    parts = written(parts_of(docs), "secret-parts")
    more = linked_parts(parts, scope)
    both = parts.alias("b").join(more.alias("m"), F.col("b.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("b._h") == F.col("m._h")), "left")
    count = lambda k: F.size(F.filter("_base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    extra = F.coalesce("m.extra", F.array().cast(SPANS))
    out = both.select("b.doc_id", *[count(k) for k in BASE], F.sha2(listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"), listed(F.concat("_base", extra)).alias("spans"))
    out = written(out, "secrets")
    drop_written(parts)
    return out
