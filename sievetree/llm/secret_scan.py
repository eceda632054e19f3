"""Secret scanning with a trigram inverted index, in DataFrame operations only.

Each rule is a regular expression. Its Boolean trigram query (trigrams.py) is intersected on an inverted index of the documents:
postings (trigram, doc_id) for every trigram that some rule demands, written to the shared folder. Only documents whose postings
satisfy a rule's query are verified with that rule's expression; rules without mandatory trigrams are run on every text.

Spans are code points, end exclusive, leftmost and without overlap in a rule. A match whose measured group is too short is
dropped; it still uses up its text, as the search goes on behind it.

Defined results: null text is the empty text, with no spans, zero counts and the hash of the empty string. Every row has its own
result, also rows that repeat an id (postings of a repeated id are merged, which only widens the candidates) and rows without id (all
rules verify them). A text may have any number of spans: their places and the redaction take n log n work.
Equal starts are ordered by rule. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import temporary, texts, written
from .trigrams import ALL, query_of, trigrams_of


@dataclass(frozen=True)
class Rule:
    """least: code points that `group` of a match must have. ignore_case is for ASCII letters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False
    base: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


#: The rules, in the order of their kinds.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("private_key", r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


def _holds(query: tuple, numbers: dict[str, int], found: Column) -> Column:
    if query == ALL:
        return F.lit(True)
    if query[0] == "tri":
        return F.array_contains(found, numbers[query[1]])
    parts = [_holds(q, numbers, found) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def index(docs: DataFrame, trigrams: list[str], path: str | None = None) -> DataFrame:
    """Postings (trigram, doc_id), trigram as its number in the list; a row for each trigram of each text, lower-cased."""
    low = texts(docs).select("doc_id", F.lower("text").alias("low"))
    hits = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return written(low.select(F.explode(hits).alias("trigram"), "doc_id"), "trigram-postings", path)


def candidates(postings: DataFrame, rules: tuple[Rule, ...], trigrams: list[str]) -> DataFrame:
    """(doc_id, cand): the numbers of the rules whose query the postings of a document satisfy."""
    numbers = {t: i for i, t in enumerate(trigrams)}
    found = postings.groupBy("doc_id").agg(F.collect_set("trigram").alias("found"))
    cand = F.array_compact(F.array(*[F.when(_holds(q, numbers, F.col("found")), F.lit(i)) for i, r in enumerate(rules) if (q := query_of(r.pattern)) != ALL] or [F.lit(None).cast("int")]))
    return found.select("doc_id", cand.alias("cand")).where(F.size("cand") > 0)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running sums (or what else `join` does) of an array of numbers from 0 up, in doubling steps: n log n work, however long it is."""
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")), lambda d: F.pow(F.lit(2.0), d).cast("int"))
    return F.aggregate(steps, values, lambda acc, step: F.transform(acc, lambda x, i: join(x, F.coalesce(F.get(acc, i - step), F.lit(0)))))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start,rule,end,at,to>> of a text that the rule's expression matches, in code points and (at, to) in bytes: what lies between the matches gives their places."""
    hits = F.regexp_extract_all(text, F.lit(rule.java), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(rule.java), F.lit(rule.group)) if rule.least and rule.group else hits

    def ends(m: Column, measure: Callable[[Column], Column]) -> Column:
        return _running(F.transform(m["hits"], lambda x, i: measure(x) + measure(F.get(m["gaps"], i))), lambda a, b: a + b)

    def spans(m: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            end, to = F.get(m["ends"], i), F.get(m["tos"], i)
            return F.struct((end - F.length(x)).alias("start"), F.lit(order).alias("rule"), end.alias("end"), (to - F.octet_length(x)).alias("at"), to.alias("to"))

        every = F.transform(m["hits"], one)
        return F.filter(every, lambda x, i: F.length(F.get(m["measured"], i)) >= rule.least) if rule.least else every

    found = F.struct(hits.alias("hits"), measured.alias("measured"), F.split(text, rule.java, -1).alias("gaps"))
    placed = lambda m: F.struct(m["hits"].alias("hits"), m["measured"].alias("measured"), ends(m, F.length).alias("ends"), ends(m, F.octet_length).alias("tos"))
    return _bound(found, lambda m: _bound(placed(m), spans))


def _marked(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row, text, found): docs' columns as a struct, so that no name of theirs meets one of this module's; the text; its spans in order of start, then rule. Rows without an id are verified by all rules."""
    queries = [query_of(r.pattern) for r in rules]
    trigrams = sorted(set().union(*map(trigrams_of, queries)))
    with temporary(docs.sparkSession):
        cand = candidates(index(docs, trigrams), rules, trigrams).select(F.col("doc_id").alias("cand_id"), "cand")
        cand = written(cand.where("cand_id is not null"), "secret-candidates", kept=True)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    every = F.lit([i for i, q in enumerate(queries) if q != ALL]).cast("array<int>")
    with_id = rows.where("id is not null").join(cand, F.col("id") == F.col("cand_id"), "left").select("row", "text", "cand")
    rows = with_id.unionByName(rows.where("id is null").select("row", "text", every.alias("cand")))
    text, none = F.col("text"), F.array().cast("array<struct<start:int,rule:int,end:int,at:int,to:int>>")
    parts = []
    for i, (r, q) in enumerate(zip(rules, queries, strict=True)):
        asked = text.rlike(r.java)
        asked = asked if q == ALL else F.coalesce(F.array_contains("cand", i), F.lit(False)) & asked
        parts.append(F.when(asked, _spans(text, r, i)).otherwise(none))
    return rows.select("row", "text", F.array_sort(F.concat(*parts)).alias("found"))


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of docs as (doc_id, text, found); found: its spans, array<struct<start,rule,end,at,to>>."""
    return _marked(texts(docs), rules).select("row.doc_id", "text", "found")


def shown(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["rule"]), x["start"].cast("string"), x["end"].cast("string"))))


def digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<kind> for each base rule, base_sha256, spans."""
    base = [i for i, r in enumerate(rules) if r.base]
    found = find(docs, rules).select("doc_id", "found")
    count = lambda i: F.size(F.filter("found", lambda x: x["rule"] == i)).cast("long").alias(f"n_{rules[i].kind}")
    counts = [count(i) for i in base]
    own = F.filter("found", lambda x: x["rule"].isin(base))
    return found.select("doc_id", *counts, F.sha2(shown(own, rules).cast("binary"), 256).alias("base_sha256"), shown(F.col("found"), rules).alias("spans"))


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of spans that overlap, replaced by the mark. Pieces are taken by their bytes, so a text is read once however many spans it has."""

    def done(m: Column) -> Column:
        heads = F.transform(m["found"], lambda s, i: F.struct(s["at"].alias("at"), F.coalesce(F.get(m["reached"], i - 1), F.lit(0)).alias("before")))
        heads = F.filter(heads, lambda h: h["at"] >= h["before"])
        pieces = F.transform(heads, lambda h: F.concat(F.substring(m["bytes"], h["before"] + 1, h["at"] - h["before"]).cast("string"), F.lit(mark)))
        rest = F.substring(m["bytes"], F.element_at(m["reached"], -1) + 1, F.length(m["bytes"])).cast("string")
        return F.concat(F.array_join(pieces, ""), rest)

    reached = _running(F.transform(found, lambda s: s["to"]), F.greatest)
    every = F.struct(text.cast("binary").alias("bytes"), found.alias("found"), reached.alias("reached"))
    return F.when(F.size(found) == 0, text).otherwise(_bound(every, done))


#: A private key's BEGIN line, and what follows it: all up to the END line, or the base64 lines where a text ends before one.
_KEY = r"(-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----)(?:[A-Za-z0-9+/=\s:,\\-]*?-----END (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----|(?:\s{1,4}[A-Za-z0-9+/=]{40,100})++(?:\s{1,4}[A-Za-z0-9+/]{1,39}={0,2}(?![^\s]))?)"


def without_key_bodies(text: Column) -> Column:
    """The text with only the BEGIN line of each private key, which the rule of that kind finds."""
    return F.when(F.contains(text, F.lit("PRIVATE KEY-----")), F.regexp_replace(text, _KEY, "$1")).otherwise(text)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs, all columns and rows, with every span in the text replaced, a private key to its end; n_chars, if there, follows. Texts without spans, also null ones, stay as they are."""
    if any(r.kind == "private_key" for r in rules):
        docs = docs.withColumn("text", without_key_bodies(F.col("text")))
    changed = F.size("found") > 0
    text = F.when(changed, redacted(F.col("text"), F.col("found"), mark)).otherwise(F.col("row.text"))
    rows = _marked(docs, rules).select("row", changed.alias("changed"), text.alias("text"))
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return rows.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
