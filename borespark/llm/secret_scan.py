"""Secret scans: base patterns and multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from borespark.llm.common import Scratch

#: Fixed patterns of the base kinds, with the group whose length counts and its least length.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),  # a shorter run after AKIA fails in any case
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
#: Weak parts: too common to report alone.  identifier: who; opaque: a secret-like string; endpoint: where.
WEAK = {
    "identifier": (r"""(?i:(user|username|login|account|client_?id|email))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+_.-]+)""", 2, 3),
    "opaque": (r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
    "endpoint": (r"""(?:[a-z][a-z0-9+]{1,12}://[^\x20\x09-\x0D"'<>]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?)""", 0, 7),
}
KINDS = [*BASE, *WEAK]
#: Which roles complete a weak part.
ROLE = {"access": "id", "identifier": "id", "assign": "secret", "hex": "secret", "opaque": "secret", "endpoint": "place"}
COMPLEMENT = {"id": ["secret"], "secret": ["id", "place"], "place": ["secret"]}
#: Code points before and after a weak part that form its scope.
SCOPE = 200
_SPAN = "struct<s:int,k:int,e:int>"
#: Characters set around a match and before its counted group; in texts they stand as _OTHER, which no pattern tells apart.
_EDGE, _INNER, _OTHER = "\x01", "\x02", "\x03"
#: What a text must contain for a kind to match at all: a cheap test before the pattern.
_HINTS = {"assign": (":", "="), "access": ("AKIA",), "identifier": (":", "=")}
#: Matches whose places are summed up in one piece, so that a text's cost stays linear in them.
PIECE = 128


def _spans(text: Column, kind: str, number: int) -> Column:
    """Spans (start, kind, end) of the matches whose counted group is long enough.

    The pattern is evaluated once: it sets marks around its matches, at which the text is then split into the
    pieces before, in and after them.  Running lengths give the places, piece by piece of ``PIECE`` matches.
    """
    pattern, group, least = (BASE | WEAK)[kind]
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(_EDGE + "$0" + (f"{_INNER}${group}" if group else "") + _EDGE))
    if kind in _HINTS:
        hint = F.lit(False)
        for x in _HINTS[kind]:
            hint = hint | text.contains(x)
        marked = F.when(hint, marked).otherwise(F.lit(""))
    empty = F.array().cast(f"array<{_SPAN}>")

    def places(parts):
        def step(acc, i):
            part = F.get(parts, 2 * i + 1)
            match = F.substring_index(part, _INNER, 1) if group else part
            s = acc["at"] + F.length(F.get(parts, 2 * i))
            e = s + F.length(match)
            long_enough = (F.length(part) - F.length(match) - 1 if group else F.length(match)) >= least
            if kind == "opaque":
                long_enough = long_enough & match.rlike("[0-9]") & match.rlike("[a-z]") & match.rlike("[A-Z]")
            span = F.struct(s.alias("s"), F.lit(number).alias("k"), e.alias("e"))
            return F.struct(e.alias("at"), F.when(long_enough, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        def piece(acc, k):
            last = F.least((k + 1) * PIECE, F.floor(F.size(parts) / 2).cast("int")) - 1
            own = F.aggregate(F.sequence(k * PIECE, last), F.struct(acc["at"].alias("at"), empty.alias("out")), step)
            return F.transform(F.array(own), lambda o: F.struct(o["at"].alias("at"), F.concat(acc["out"], F.array(o["out"])).alias("out")))[0]

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("out"))
        pieces = F.sequence(F.lit(0), F.floor((F.size(parts) - 3) / 2 / PIECE).cast("int"))
        return F.when(F.size(parts) < 3, empty).otherwise(F.flatten(F.aggregate(pieces, start, piece)["out"]))

    return F.transform(F.array(F.split(marked, _EDGE, -1)), places)[0]


def _render(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_parts(docs: DataFrame) -> DataFrame:
    """doc_id, row key (h1, h2), arrays base and weak of spans (start, kind number, end), by whole text.

    Opaque strings need a digit, a lower-case and an upper-case letter.
    """
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumns({"h1": F.xxhash64("doc_id", "text"), "h2": F.hash("text", "doc_id")})
    text = F.col("text")
    marks = text.contains(_EDGE) | text.contains(_INNER)
    df = df.withColumn("text", F.when(marks, F.translate(text, _EDGE + _INNER, _OTHER * 2)).otherwise(text))
    df = df.select("doc_id", "h1", "h2", *[_spans(text, k, n).alias(f"s_{k}") for n, k in enumerate(KINDS)])
    return df.select("doc_id", "h1", "h2", F.concat(*[f"s_{k}" for k in BASE]).alias("base"), F.concat(*[f"s_{k}" for k in WEAK]).alias("weak"))


def _free_parts(found: DataFrame) -> DataFrame:
    """(h1, h2, s, k, e), a row per part of each distinct text; weak parts that overlap a base span are left out.

    In the order of starts, a base span that begins before a weak part reaches into it if the farthest end so far
    does, and one that begins later if the nearest start to come lies inside.
    """
    part = found.where(F.size("weak") > 0).dropDuplicates(["h1", "h2"]).select("h1", "h2", F.explode(F.concat("base", "weak")).alias("x"))
    part = part.select("h1", "h2", F.col("x.s").alias("s"), F.col("x.k").alias("k"), F.col("x.e").alias("e"))
    base = F.col("k") < len(BASE)
    by = Window.partitionBy("h1", "h2")
    rising, falling = (w.rangeBetween(Window.unboundedPreceding, Window.currentRow) for w in (by.orderBy("s"), by.orderBy(F.desc("s"))))
    part = part.withColumns({"reach": F.max(F.when(base, F.col("e"))).over(rising), "next": F.min(F.when(base, F.col("s"))).over(falling)})
    overlaps = (F.coalesce("reach", F.lit(-1)) > F.col("s")) | F.coalesce(F.col("next") < F.col("e"), F.lit(False))
    return part.where(base | ~overlaps).select("h1", "h2", "s", "k", "e")


def link_credentials(docs: DataFrame, scope: int = SCOPE, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): base counts and digest, all spans, and the linked parts.

    Parts are joined by interval: a weak part is reported only if a part that completes it (an identifier
    for a secret, a secret for an identifier or an endpoint, an endpoint for a secret) starts at most
    ``scope`` code points before its start or after its end.  The join runs over cells of ``scope`` code
    points; for each cell and role only the first and last start are kept, which decides the same
    question, so rows stay linear in the parts however many stand together.

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.  spans lists kind:start:end by
    start, then kind (assign, access, hex, identifier, opaque, endpoint); code points, end exclusive.
    Null texts count as empty (no spans, the digest of the empty text).  Repeated rows give repeated
    results.  Columns other than doc_id and text are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "secrets")
    found = scratch.keep(find_parts(docs), "parts")
    roles = F.array(*[F.lit(ROLE[k]) for k in KINDS])
    part = scratch.keep(_free_parts(found).withColumn("role", F.element_at(roles, F.col("k") + 1)), "free")
    cells = part.groupBy("h1", "h2", "role", F.floor(F.col("s") / scope).alias("cell")).agg(F.min("s").alias("first"), F.max("s").alias("last"))
    wanted = F.lit(None).cast("array<string>")
    for role, others in COMPLEMENT.items():
        wanted = F.when(F.col("role") == role, F.array(*[F.lit(o) for o in others])).otherwise(wanted)
    weak = part.where(F.col("k") >= len(BASE)).withColumn("want", F.explode(wanted))
    weak = weak.withColumn("cell", F.explode(F.sequence(F.floor((F.col("s") - scope) / scope), F.floor((F.col("e") + scope) / scope))))
    joined = weak.select("h1", "h2", "s", "k", "e", F.col("want").alias("role"), "cell").join(cells, ["h1", "h2", "role", "cell"]).where((F.col("last") >= F.col("s") - scope) & (F.col("first") <= F.col("e") + scope))
    linked = joined.groupBy("h1", "h2").agg(F.collect_set(F.struct("s", "k", "e")).cast(f"array<{_SPAN}>").alias("linked"))
    both = found.join(linked, ["h1", "h2"], "left").withColumn("linked", F.coalesce("linked", F.array().cast(f"array<{_SPAN}>")))

    def number(kind):
        return F.size(F.filter("base", lambda x: x["k"] == KINDS.index(kind))).cast("long")

    return both.select("doc_id", *[number(k).alias(f"n_{k}") for k in BASE], F.sha2(_render(F.col("base")), 256).alias("base_sha256"), _render(F.concat("base", "linked")).alias("spans"), F.size("linked").cast("long").alias("n_linked"))
