"""Secret scans with multipart credential linking.

Base findings are pattern matches in the whole text. Weak candidates are parts that mean nothing alone: secret-shaped tokens, identifiers of
accounts and endpoints of named services, each of a family (see ``FAMILIES``). An interval join links the parts of one family that start within
``scope`` characters of each other: parts are dealt into cells of that length, and each looks into its own cell and the two beside
it. A secret, and an identifier that is no base finding, is reported where the other one lies in its scope; an endpoint only beside both an identifier
and a secret that are linked. A cell holds a bounded number of parts, so no join grows with the square of a document.

Spans are in code points, end exclusive. They are found in time that grows little faster than their number, however long the text. Defined results: a null
text is an empty one without findings. Equal texts have equal findings, so null and repeated ids, and repeated rows, need no rule. Spans of
several kinds may overlap; where a text is redacted, the one that starts first (of equals the first kind) gives its name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gearledger.functions.text import let
from gearledger.llm.common import cut_lineage, text_or_empty

#: The patterns of the base kinds. The keyword of an assignment is matched in either case.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
_HOST = r"(?<![A-Za-z0-9.-])(?:https?://)?(?:[a-z0-9-]{{1,63}}\.){{1,8}}{0}(?![A-Za-z0-9-])(?::[0-9]+)?(?:/[^\s\"'<>]*+)?"
#: Families of credentials: a string that every identifier of the family contains, and the patterns of its identifiers (None: base findings of kind
#: access), secrets and endpoints. An equals sign before a secret is an assignment (KEY=secret), behind it it is padding. Forty hex digits are a
#: checksum, not a secret.
FAMILIES = (
    ("AKIA", None, r"(?<![A-Za-z0-9+/_-])(?![0-9A-Fa-f]{40}(?![A-Za-z0-9+/=_-]))[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", _HOST.format(r"amazonaws\.com")),
    ("AccountName=", r"(?<=AccountName=)[a-z0-9]{3,24}(?![A-Za-z0-9])", r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{86}==", _HOST.format(r"core\.windows\.net")),
    (".apps.googleusercontent.com", r"(?<![A-Za-z0-9-])[0-9]{6,20}-[a-z0-9]{32}\.apps\.googleusercontent\.com", r"GOCSPX-[A-Za-z0-9_-]{28}(?![A-Za-z0-9_-])", _HOST.format(r"googleapis\.com")),
)
#: The kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "secret", "endpoint", "identifier")
SPAN = "array<struct<start:int,kind:int,end:int>>"
PART = "array<struct<family:int,kind:int,start:int,end:int>>"
CHUNK = 1024


def running(values: Column, of: Callable[[Column, Column], Column]) -> Column:
    """For each entry of an integer array the fold of the entries before it, 0 for the first. In blocks, so the work is their number times its root."""
    fold = lambda part: F.aggregate(part, F.lit(0), lambda a, x: of(a, x).cast("int"))

    def cut(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / width).cast("int") - 1), lambda j: F.slice(v, j * width + 1, width))

    def joined(blocks: Column) -> Column:
        starts = let(F.transform(blocks, fold), lambda totals: F.transform(totals, lambda _, j: fold(F.slice(totals, F.lit(1), j))))
        return let(starts, lambda first: F.flatten(F.transform(blocks, lambda block, j: F.transform(
            block, lambda _, i: of(F.get(first, j), fold(F.slice(block, F.lit(1), i))).cast("int")))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(cut(v), joined)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """``array<struct<start, end, group>>`` of the matches of a pattern, with the text of a group.

    The gaps between matches come from a split by the same pattern; starts are running sums of gaps and matches.
    """
    def placed(found: Column) -> Column:
        groups = F.regexp_extract_all(text, F.lit(pattern), group) if group else found
        parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"), found.alias("hit"), groups.alias("group"))
        sized = F.transform(parts, lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.length(p["hit"]).alias("hit"), p["group"].alias("group")))
        return let(sized, lambda all_: let(running(F.transform(all_, lambda p: p["gap"] + p["hit"]), lambda a, x: a + x), lambda before: F.transform(
            all_, lambda p, i: F.struct((F.get(before, i) + p["gap"]).alias("start"), (F.get(before, i) + p["gap"] + p["hit"]).alias("end"), p["group"].alias("group")))))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda found: F.when(F.size(found) > 0, placed(found)))


def spans(text: Column, pattern: str, kind: str, least: int = 0, group: int = 0) -> Column:
    """Matches of a pattern as (start, kind, end); the group must have ``least`` characters."""
    kept = F.filter(matches(text, pattern, group), lambda m: F.length(m["group"]) >= least)
    made = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))
    return F.coalesce(made, F.array()).cast(SPAN)


def written(found: Column) -> Column:
    """kind:start:end, by start and kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_family(found: Column, family: int) -> Column:
    return F.transform(found, lambda s: F.struct(F.lit(family).alias("family"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def parts_of(text: Column) -> dict[str, Column]:
    """Base findings by kind, and the weak parts of the families whose identifiers occur."""
    access = F.when(F.contains(text, F.lit("AKIA")), spans(text, ACCESS, "access", 16)).otherwise(F.array().cast(SPAN))
    weak = []
    for family, (mark, identifier, secret, endpoint) in enumerate(FAMILIES):
        for kind, pattern in (("identifier", identifier), ("secret", secret), ("endpoint", endpoint)):
            if pattern is not None:
                weak.append(F.when(F.contains(text, F.lit(mark)), _of_family(spans(text, pattern, kind), family)).otherwise(F.array()).cast(PART))
    # A run of hex digits is one match, so asking for the least length in the pattern drops the same matches.
    return {"assign": spans(text, ASSIGN, "assign", 8, 2), "access": access, "hex": spans(text, r"[0-9a-f]{32,}+", "hex", 32), "weak": F.concat(*weak)}


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def linked_parts(found: DataFrame, scope: int) -> DataFrame:
    """(t1, t2, linked) of the texts in which parts of one family lie within each other's scope."""
    parts = found.filter(F.size("weak") > 0).select("t1", "t2", "access", "weak").dropDuplicates(["t1", "t2"])
    rows = cut_lineage(parts.select("t1", "t2", F.inline(F.concat("weak", _of_family(F.col("access"), 0).cast(PART)))))
    cell = F.floor(F.col("start") / scope).cast("int")
    by = ["t1", "t2", "family", "cell"]
    here = rows.withColumn("cell", cell)
    around = rows.select("t1", "t2", "family", "kind", F.col("start").alias("near"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))

    def beside(side: DataFrame, other: DataFrame) -> DataFrame:
        """Rows of one side with a row of the other in their scope."""
        a, b = side.alias("a"), other.alias("b")
        same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in by]
        return a.join(b, same[0] & same[1] & same[2] & same[3] & (F.abs(F.col("a.start") - F.col("b.near")) <= scope), "left_semi")

    of = lambda frame, *kinds: frame.filter(F.col("kind").isin(*[KINDS.index(k) for k in kinds]))
    secrets = beside(of(here, "secret"), of(around, "access", "identifier"))
    named = beside(of(here, "access", "identifier"), of(around, "secret"))
    spread = lambda frame: frame.select("t1", "t2", "family", F.col("start").alias("near"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    endpoints = beside(beside(of(here, "endpoint"), spread(secrets)), spread(named))
    hits = secrets.unionByName(of(named, "identifier")).unionByName(endpoints).select("t1", "t2", F.struct("start", "kind", "end").alias("p"))
    return hits.groupBy("t1", "t2").agg(F.collect_set("p").cast(SPAN).alias("linked"))


def scan(docs: DataFrame, scope: int = 400) -> DataFrame:
    """Findings of every row of ``docs`` (doc_id, text): doc_id, t1, t2 (the text's hashes), n_assign, n_access, n_hex, base, linked (spans)."""
    rows = docs.select(F.col("doc_id"), text_or_empty().alias("text"))
    found = cut_lineage(rows.select("doc_id", *_text_key(F.col("text")), *[c.alias(k) for k, c in parts_of(F.col("text")).items()]))
    out = found.join(linked_parts(found, scope), ["t1", "t2"], "left")
    return out.select(
        "doc_id", "t1", "t2", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.concat("assign", "access", "hex").alias("base"), F.coalesce("linked", F.array().cast(SPAN)).alias("linked"),
    )


def redact(text: Column, found: Column) -> Column:
    """The text with every span replaced by [KIND]; overlapping spans are covered by the one that starts first."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def made(chunks: Column, ordered: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            """Code points from a to b. Looking one up in a long text means walking to it, so the text is held in chunks."""
            i, j = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
            head, tail = (a % CHUNK + 1).cast("int"), ((b - 1) % CHUNK + 1).cast("int")
            several = F.concat(F.substring(F.get(chunks, i), head, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(F.get(chunks, j), F.lit(1), tail))
            return F.when(b <= a, "").when(i == j, F.substring(F.get(chunks, i), head, (b - a).cast("int"))).otherwise(several)

        ends = F.transform(ordered, lambda s: s["end"])
        pieces = let(running(ends, lambda a, x: F.greatest(a, x)), lambda before: F.transform(ordered, lambda s, i: F.concat(
            cut(F.get(before, i), s["start"]), F.when(s["start"] >= F.get(before, i), F.get(names, s["kind"])).otherwise(""))))
        return F.concat(F.array_join(pieces, ""), cut(F.array_max(ends), F.length(text)))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    whole = let(F.struct(chunks.alias("chunks"), F.array_sort(found).alias("spans")), lambda t: made(t["chunks"], t["spans"]))
    return F.when(F.size(found) > 0, whole).otherwise(text)


def redacted(docs: DataFrame, scope: int = 400) -> DataFrame:
    """``docs`` with every finding, base or linked, replaced by its kind; n_chars, where there is such a column, is counted anew. A null text stays null."""
    found = scan(docs, scope).select("t1", "t2", F.concat("base", "linked").alias("found"))
    found = found.filter(F.size("found") > 0).dropDuplicates(["t1", "t2"])
    # The columns of the documents go through as one value, so their names can't clash.
    rows = docs.select(*_text_key(text_or_empty()), F.struct(*docs.columns).alias("row")).join(found, ["t1", "t2"], "left")
    rows = rows.select("row", F.col("found").isNotNull().alias("hit"), F.when(F.col("found").isNotNull(), redact(F.col("row.text"), F.col("found"))).alias("clean"))
    made = {"text": F.col("clean"), "n_chars": F.length("clean").cast("bigint")}
    old = lambda c: F.col("row").getField(c)
    return rows.select(*[(F.when(F.col("hit"), made[c]).otherwise(old(c)) if c in made else old(c)).alias(c) for c in docs.columns])
