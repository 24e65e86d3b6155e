"""Secret scans with an incremental blob ledger (operator 6, native).

Every version of every file is addressed by its content (SHA-256). The ledger
is a Parquet table with a row per scanned blob and scan: the rule versions
that were applied and the spans they found. A scan reads each distinct
content once, applies only those rule versions that the ledger lacks for it,
appends its rows to the ledger, and joins the findings back to all paths that
ever held the content.

Matches are leftmost, non-overlapping, found with ``regexp_extract_all``; the
pieces between them (``split`` by the same pattern) give their positions in
code points. Positions are running sums over the exploded pieces, inside the
partitioning by blob that the content-addressing has made, so a text with
very many matches stays linear. A content with a third of all paths is one blob
after map-side deduplication; the join back to the paths is an equi-join that
adaptive execution splits.

Defined results: a null text is the empty content; a null path is a path
like others; repeated rows stay repeated rows; paths without findings have an empty
list; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adlens.session import checkpoint_dir


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if its ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        text = f"{self.pattern}\x00{self.group}\x00{self.least}"
        return f"{self.kind}@{hashlib.sha256(text.encode()).hexdigest()[:12]}"


#: Fixed values. The quantified forms of access and hex find the same spans as
#: the shortest forms with a later length filter: a maximal run shorter than
#: the limit holds no longer match.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)

LEDGER = "blob binary, applied array<string>, spans array<struct<start:int,rule:string,end:int>>"
_SPANS = "array<struct<start:int,rule:string,end:int>>"


def _found(rule: Rule) -> Column:
    """Array of (between, matched, counts): lengths of the text before each match and of the match."""
    whole = f"({rule.pattern})"
    hits = F.regexp_extract_all("text", F.lit(whole), F.lit(1))
    enough = (lambda m: F.char_length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least)
    between = F.split(F.col("text"), rule.pattern, -1)
    rows = F.zip_with(
        F.transform(hits, lambda m: F.struct(F.char_length(m).alias("n"), enough(m).alias("ok"))),
        F.transform(F.slice(between, F.lit(1), F.size(hits)), F.char_length),
        lambda m, gap: F.struct(F.lit(rule.version).alias("rule"), gap.alias("gap"), m["n"].alias("n"),
                                m["ok"].alias("ok")))
    none = F.array().cast("array<struct<rule:string,gap:int,n:int,ok:boolean>>")
    return F.when(F.col("text").rlike(rule.pattern), rows).otherwise(none)


def scan_new(versions: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame | None) -> DataFrame:
    """Ledger rows for the blobs of ``versions`` (blob, text) and rule versions that ``ledger`` lacks."""
    blobs = versions.dropDuplicates(["blob"])
    want = F.array(*(F.lit(r.version) for r in rules))
    if ledger is None:
        todo = blobs.withColumn("applied", want)
    else:
        known = ledger.groupBy(F.col("blob").alias("k")).agg(F.flatten(F.collect_set("applied")).alias("done"))
        todo = (blobs.join(known, blobs["blob"] == known["k"], "left")
                .select("blob", "text", F.array_except(want, F.coalesce("done", F.array().cast("array<string>")))
                        .alias("applied")).where(F.size("applied") > 0))
    none = F.array().cast("array<struct<rule:string,gap:int,n:int,ok:boolean>>")
    found = F.concat(*(F.when(F.array_contains("applied", r.version), _found(r)).otherwise(none) for r in rules))
    each = todo.select("blob", "applied", F.posexplode_outer(found).alias("pos", "m"))
    run = Window.partitionBy("blob", "m.rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.n")).over(run).cast("int")
    return (each.withColumn("end", end)
            .groupBy("blob").agg(
                F.first("applied").alias("applied"),
                F.array_sort(F.collect_list(F.when(F.col("m.ok"), F.struct(
                    (F.col("end") - F.col("m.n")).alias("start"), F.col("m.rule").alias("rule"), F.col("end")))))
                .cast(_SPANS).alias("spans")))


def scan_versions(versions: DataFrame, *, path_col: str = "path", text_col: str = "text",
                  rules: tuple[Rule, ...] = RULES, ledger_path: str | None = None) -> DataFrame:
    """``path, blob, spans`` for every row of ``versions``; spans (start, kind, end) are
    sorted by start, then by the order of the rules. New scans are appended to the ledger at ``ledger_path``
    (a fresh one in the checkpoint folder if none is given)."""
    spark = versions.sparkSession
    at = ledger_path or f"{checkpoint_dir(spark).rstrip('/')}/llm/ledger-{uuid.uuid4().hex[:12]}"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    v = versions.select(F.col(path_col).alias("path"), text.alias("text"),
                        F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"))
    known = read_ledger(spark, at) if ledger_path else None
    scan_new(v.select("blob", "text"), rules, known).write.mode("append").parquet(at)
    order = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.version, i)))
    kind = F.create_map(*(F.lit(x) for r in rules for x in (r.version, r.kind)))
    rows = spark.read.schema(LEDGER).parquet(at).select("blob", F.filter(
        "spans", lambda s: F.array_contains(F.lit([r.version for r in rules]), s["rule"])).alias("spans"))
    if ledger_path:  # a blob has a row per scan that added rule versions to it
        rows = rows.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    ranked = F.array_sort(F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), order[s["rule"]].alias("rank"), s["end"].alias("end"), kind[s["rule"]].alias("kind"))))
    found = rows.select(F.col("blob").alias("of"), F.transform(ranked, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("spans")).where(F.size("spans") > 0)
    paths = v.select("path", "blob")
    return (paths.join(found, paths["blob"] == found["of"], "left")
            .select(F.col("path").alias(path_col), "blob",
                    F.coalesce("spans", F.array().cast("array<struct<start:int,kind:string,end:int>>")).alias("spans")))


def read_ledger(spark, path: str) -> DataFrame | None:
    """The ledger, or None if nothing has been written there yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(LEDGER).parquet(path) if fs.exists(p) else None


def span_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


_PIECE = 1024  # code points: substring() counts from the start of what it cuts


def _kept_ranges(found: DataFrame) -> DataFrame:
    """Per blob the ranges (``a``, ``z``) of its text between the marks, the last one open (``z`` null). A span
    that starts inside an earlier one belongs to its mark."""
    each = found.select("__of", F.posexplode("__spans").alias("pos", "s"))
    before = Window.partitionBy("__of").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = each.withColumn("a", F.coalesce(F.max("s.end").over(before), F.lit(0)))
    marks = at.where("s.start >= a").select("__of", "a", F.col("s.start").alias("z"))
    tails = each.groupBy("__of").agg(F.max("s.end").alias("a")).withColumn("z", F.lit(None).cast("int"))
    order = F.struct(F.col("z").isNull().alias("last"), "a", "z")  # an empty range may start where the tail does
    return marks.unionByName(tails).groupBy("__of").agg(F.array_sort(F.collect_list(order)).alias("__ranges"))


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES,
           id_col: str = "doc_id", ledger_path: str | None = None) -> DataFrame:
    """``docs`` with the found spans replaced by ``mark``; texts without findings are unchanged.
    Overlapping spans become one mark. Texts are joined to findings by content; a text with very many
    findings is put together in linear time, from pieces of fixed size."""
    names = docs.columns
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumn("__blob", F.unhex(F.sha2(text.cast("binary"), 256)))
    found = (scan_versions(docs, path_col=id_col, text_col=text_col, rules=rules, ledger_path=ledger_path)
             .where(F.size("spans") > 0).groupBy(F.col("blob").alias("__of")).agg(F.first("spans").alias("__spans")))
    joined = keyed.join(_kept_ranges(found), F.col("__blob") == F.col("__of"), "left")

    def between(pieces: Column, a: Column, z: Column) -> Column:
        def cut(k: Column) -> Column:
            first = F.greatest(a - k * _PIECE, F.lit(0))
            return F.substring(F.get(pieces, k), first + 1, F.least(z - k * _PIECE, F.lit(_PIECE)) - first)
        whole = F.transform(F.sequence(F.floor(a / _PIECE).cast("int"), F.floor((z - 1) / _PIECE).cast("int")), cut)
        return F.when(z > a, F.array_join(whole, "")).otherwise("")

    # the name of a lambda holds the pieces, so they are cut once a text
    pieces = F.array(F.regexp_extract_all(text_col, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)))
    n = F.char_length(text_col)
    clean = F.element_at(F.transform(pieces, lambda ps: F.array_join(
        F.transform("__ranges", lambda r: between(ps, r["a"], F.coalesce(r["z"], n))), mark)), 1)
    return joined.select(*(F.when(F.col("__ranges").isNull(), F.col(c)).otherwise(clean).alias(c) if c == text_col
                           else F.col(c) for c in names))
