"""Rule-based annotation of nodes.

Most detectors look at one node only.  They are column expressions giving an array of
hits, so all of them run in one scan and one ``explode``; the association detectors
need the next node and work on the whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursewright.functions.text import WORD_START, strip
from coursewright.operators import sequence as Q

HIT = "type string, detector string, ord int, confidence double, term string, body string, kind string"

# The detection patterns.  (?d): only \n ends a line.


def word_run(keywords: str, rest: str, tail: str | None = None) -> str:
    """Words of two letters or more, single spaces between, up to the last keyword of the run.

    ``rest`` is what has to follow a keyword; ``tail`` stands in its place at the end.

    Java recurses once per turn of a repeated group, so a long run of words would
    exhaust a task's stack.  Possessive loops do not recurse; the lookaheads stop them at
    the last keyword, where a backtracking loop would have ended up.  A word inside a run
    cannot match when the run's first word did not, so only first words are tried: without
    that, a page of words and no keyword would cost the square of its length.
    """
    word, usable = "[A-Za-z]{2,}+", f"{keywords}{rest}"
    plain = rf"\s(?!{usable}){word}"
    passed = rf"\s(?={usable}){word}(?=(?:{plain})*+\s+{usable})"
    first = rf"(?<!{WORD_START}[A-Za-z]{{2,30}}\s)"
    return rf"{WORD_START}{first}({word}(?:{plain}|{passed})*+)\s+{keywords}{tail or rest}"


DEFINITION = r"(?id)(?:Definition|Def\.?|Define)\s*(?:\d+[\.:)])?\s*[:\-–—]\s*([^\n]+)"
INLINE_DEFINITION = "(?d)" + word_run("(?:is|are|refers to|means|denotes)", r"\s+.", r"\s+(.[^.;,\n]*)")
EXAMPLE = (
    r"(?id)" + WORD_START + r"((?:Example|Ex\.|For instance|Consider|Observe)\s*(?:\d+[\.:)])?\s*[:\-–—]?\s*(?:.*))"
)
NON_EXAMPLE = r"(?id)" + WORD_START + r"(?:Non-?example|Counterexample|Incorrect|Wrong)"
EXERCISE = (
    r"(?id)" + WORD_START + r"(?:Exercise|Problem|Question|Practice|Quiz)(?:\s+\d+)?\s*[:\-–—]"
)
OBJECTIVE = (
    r"(?id)(?:Learning Objective|Objective|Outcome|After completing|By the end|Students will|You will|Aim|Goal)\s*"
    r"(?:\d+[\.:)])?\s*[:\-–—]?\s*([^\n]+)"
)
SUMMARY = (
    r"(?imd)^\s*(?:Summary|Recap|Review|Key Takeaways?|Chapter Summary|Section Summary|In summary|To summarize"
    r"|In conclusion|Conclusion)"
)
CALLOUT = (
    r"(?id)((?:Note|Tip|Warning|Caution|Important|Remember|Info|Danger|Key Point|Did you know)\s*"
    r"(?:\d+[\.:)])?\s*[:\-–—]?\s*(?:.*))"
)
CALLOUT_KINDS = {
    "note": "info", "info": "info", "tip": "example", "did you know": "example", "important": "reminder",
    "remember": "reminder", "key point": "reminder", "warning": "non_example", "caution": "non_example",
    "danger": "non_example",
}
LABEL = r"(?i)(?:Section|Chapter|Figure|Fig\.?|Table|Equation|Eq\.?|Appendix)\s*(\d+(?:\.\d+)*+)"
CROSS_REF = (
    r"(?i)(?:see|refer to|as shown in|as discussed in|from|in)\s+"
    r"(?:Section|Chapter|Figure|Fig\.?|Table|Equation|Eq\.?|Appendix)\s*(\d+(?:\.\d+)*+)"
)
BOLD = r"(?d)\*\*(.*?[\p{L}\p{N}_])\*\*"
# What every match of INLINE_DEFINITION and TERM_SITE has.
LINKED = r"(?i)\s(?:is|are|refers to|means|denotes)\s"
TERM_SITE = "(?i)" + word_run("(?:is|are|refers to|means|denotes)", r"\s+")

def _all(pattern: str, group: int) -> Column:
    return F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(group))


def _hit(kind_of: str, detector: str, confidence: float, ord_: Column, term=None, body=None, kind=None) -> Column:
    def text(v):
        return (F.lit(v) if v is None or isinstance(v, str) else v).cast("string")

    return F.struct(
        F.lit(kind_of).alias("type"),
        F.lit(detector).alias("detector"),
        ord_.cast("int").alias("ord"),
        F.lit(confidence).alias("confidence"),
        text(term).alias("term"),
        text(body).alias("body"),
        text(kind).alias("kind"),
    )


def _none() -> Column:
    return F.array().cast(f"array<struct<{HIT.replace(' ', ':').replace(',:', ',')}>>")


def _if(test: Column, hits: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), hits).otherwise(_none())


def _has(*words: str) -> Column:
    """Whether a text can match at all: it holds one of the words that each match has, whatever their case."""
    return reduce(lambda a, b: a | b, [F.lower("text").contains(w) for w in words])


def _pairs(pattern: str, a: int, b: int) -> Column:
    return F.arrays_zip(_all(pattern, a).alias("a"), _all(pattern, b).alias("b"))


def _before_colon(raw: Column, default: str) -> Column:
    return F.when(raw.contains(":"), strip(F.substring_index(raw, ":", 1))).otherwise(F.lit(default))


def title_case(value: Column) -> Column:
    """First letter of every run of letters upper, the rest lower."""
    runs = F.regexp_extract_all(value, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def detect_definitions() -> Column:
    marked = F.transform(
        _pairs(DEFINITION, 0, 1),
        lambda p, i: _hit("definition", "DefinitionDetector", 0.9, i, _before_colon(p["a"], "Definition"), strip(p["b"])),
    )
    inline = F.transform(
        _pairs(INLINE_DEFINITION, 1, 2),
        lambda p, i: _hit("definition", "DefinitionDetector", 0.7, i + 1000000, strip(p["a"]), strip(p["b"])),
    )
    prose = F.col("node_type").isin("paragraph", "heading", "note")
    return F.concat(_if(prose & _has("def"), marked), _if(prose & F.col("text").rlike(LINKED), inline))


def detect_examples() -> Column:
    raw = F.regexp_extract(F.col("text"), EXAMPLE, 1)
    good = _hit("example", "ExampleDetector", 0.85, F.lit(0), _before_colon(raw, "Example"), F.col("text"), "positive")
    bad = _hit("example", "ExampleDetector", 0.85, F.lit(0), "Non-example", F.col("text"), "negative")
    hit = F.when(F.col("text").rlike(NON_EXAMPLE), F.array(bad)).when(F.col("text").rlike(EXAMPLE), F.array(good)).otherwise(_none())
    worded = _has("example", "ex.", "for instance", "consider", "observe", "incorrect", "wrong")
    return _if(F.col("node_type").isin("paragraph", "heading", "note") & worded, hit)


def detect_exercises() -> Column:
    typed = F.array(_hit("exercise", "ExerciseDetector", 1.0, F.lit(0), None, F.col("text"), "unknown"))
    found = F.array(_hit("exercise", "ExerciseDetector", 0.75, F.lit(0), None, F.col("text"), "unknown"))
    worded = _has("exercise", "problem", "question", "practice", "quiz")
    return (
        F.when(F.col("node_type").isin("exercise", "question"), typed)
        .when(F.col("node_type").isin("paragraph", "heading") & worded & F.col("text").rlike(EXERCISE), found)
        .otherwise(_none())
    )


def detect_objectives() -> Column:
    hits = F.transform(
        _pairs(OBJECTIVE, 0, 1),
        lambda p, i: _hit(
            "objective", "ObjectiveDetector", 0.85, i, None,
            F.when(strip(p["b"]) != "", strip(p["b"])).otherwise(strip(p["a"])),
        ),
    )
    worded = _has("objective", "outcome", "after completing", "by the end", "students will", "you will", "aim", "goal")
    return _if(F.col("node_type").isin("paragraph", "heading", "note") & worded, hits)


def detect_summaries() -> Column:
    hit = F.array(_hit("summary", "SummaryDetector", 0.85, F.lit(0), None, F.col("text")))
    worded = _has("summar", "recap", "review", "key takeaway", "conclusion")
    return _if(F.col("node_type").isin("paragraph", "heading") & worded & F.col("text").rlike(SUMMARY), hit)


def _callout_kind(word: Column) -> Column:
    mapping = F.create_map(*[F.lit(v) for kv in CALLOUT_KINDS.items() for v in kv])
    return F.coalesce(F.try_element_at(mapping, word), F.lit("info"))


def detect_callouts() -> Column:
    raw = F.regexp_extract(F.col("text"), CALLOUT, 1)
    word = F.lower(strip(F.substring_index(F.substring_index(raw, ":", 1), ".", 1)))
    found = _hit("callout", "CalloutDetector", 0.8, F.lit(0), title_case(word), F.col("text"), _callout_kind(word))
    typed = _hit("callout", "CalloutDetector", 1.0, F.lit(0), title_case(F.col("node_type")), F.col("text"), _callout_kind(F.col("node_type")))
    worded = _has("note", "tip", "warning", "caution", "important", "remember", "info", "danger", "key point", "did you know")
    return (
        F.when(F.col("node_type").isin("note", "callout"), F.array(typed))
        .when((F.col("node_type") == "paragraph") & worded & F.col("text").rlike(CALLOUT), F.array(found))
        .otherwise(_none())
    )


def detect_cross_refs() -> Column:
    full = F.transform(_all(CROSS_REF, 0), lambda v: strip(v))
    number = lambda v: F.regexp_extract(v, r"(\d+(?:\.\d+)*+)$", 1)
    refs = F.transform(
        full, lambda v, i: _hit("cross_reference", "CrossReferenceDetector", 0.85, i, v, number(v))
    )
    bare = F.array_except(F.transform(_all(LABEL, 0), lambda v: strip(v)), full)
    labels = F.transform(
        bare, lambda v, i: _hit("cross_reference", "CrossReferenceDetector", 0.6, i + 1000000, v, number(v))
    )
    worded = _has("section", "chapter", "fig", "table", "eq", "appendix")
    return F.concat(
        _if(F.col("node_type").isin("paragraph", "heading", "note") & worded, refs), _if((F.col("node_type") == "paragraph") & worded, labels)
    )


def key_term_candidates() -> Column:
    """Every bold or defined term; ``first_occurrence_terms`` keeps the first per document."""
    bold = F.transform(
        _all(BOLD, 1), lambda v, i: _hit("key_term", "KeyTermDetector", 0.9, i, strip(v), F.col("text"))
    )
    sites = F.transform(
        _all(TERM_SITE, 1), lambda v, i: _hit("key_term", "KeyTermDetector", 0.7, i + 1000000, strip(v), F.col("text"))
    )
    prose = F.col("node_type").isin("paragraph", "heading")
    both = F.concat(_if(prose & F.col("text").contains("**"), bold), _if(prose & F.col("text").rlike(LINKED), sites))
    return F.filter(both, lambda h: h["term"] != "")


def first_occurrence_terms(hits: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Each key term once per document (or per page): the earliest node and match wins."""
    keys = list(keys)
    rest = [c for c in hits.columns if c not in keys]
    firsts = hits.groupBy(*keys, F.lower("term").alias("_term")).agg(
        F.min_by(F.struct(*rest), F.struct("seq", "ord")).alias("_row")
    )
    return firsts.select(*[F.col(k) if k in keys else F.col(f"_row.{k}").alias(k) for k in hits.columns])


def _associations(nodes: DataFrame, node_type: str, kind: str, detector: str, label: Column | None) -> DataFrame:
    seen = Q.following(nodes, ["doc_id"], "seq", "_next", ["node_type", "text"]).where(F.col("node_type") == node_type)
    caption = F.coalesce(F.col("caption"), F.lit(""))
    nearby = F.when(F.col("_next.node_type") == "paragraph", F.col("_next.text")).otherwise("")
    sure = F.lit(0.9) if label is not None else F.when(caption != "", 0.9).otherwise(0.5)
    return seen.select(
        "doc_id",
        "node_id",
        "seq",
        F.lit(kind).alias("type"),
        F.lit(detector).alias("detector"),
        F.lit(0).alias("ord"),
        sure.alias("confidence"),
        (F.lit(None).cast("string") if label is None else label).alias("term"),
        F.when(caption != "", caption).otherwise(F.coalesce(nearby, F.lit(""))).alias("body"),
        F.lit(None).cast("string").alias("kind"),
    )


def figure_nearby_text(nodes: DataFrame) -> DataFrame:
    """A figure's caption (0.9), else the paragraph after it (0.5)."""
    return _associations(nodes, "figure", "figure_association", "FigureAssociationDetector", None)


def equation_nearby_text(nodes: DataFrame) -> DataFrame:
    """An equation with its label and caption, or the paragraph after it (always 0.9)."""
    label = F.concat(F.lit("Eq. "), F.col("node_id"))
    return _associations(nodes, "equation", "equation_association", "EquationAssociationDetector", label)


def _numbered(emit: int) -> Callable[[Column], Column]:
    return lambda h: h.withField("emit", F.lit(emit))


@dataclass
class Annotator:
    """Ordered detectors: per-node column detectors, then table detectors.

    ``failed`` holds, after ``run``, the errors of detectors whose columns could not be built;
    with ``fail_fast`` the first of them is raised.  Errors while rows are read fail the query.
    """

    columns: dict[str, Callable[[], Column]] = field(default_factory=dict)
    tables: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    fail_fast: bool = True
    failed: dict[str, Exception] = field(default_factory=dict)

    def _note(self, name: str, error: Exception) -> None:
        if self.fail_fast:
            raise RuntimeError(f"detector {name} failed") from error
        self.failed[name] = error

    def register(self, name: str, fn: Callable, *, table: bool = False) -> Annotator:
        (self.tables if table else self.columns)[name] = fn
        return self

    def run(self, nodes: DataFrame) -> DataFrame:
        """All annotations with ``emit``, the position of their detector."""
        arrays, frames = [], []
        self.failed.clear()
        for i, (name, fn) in enumerate(self.columns.items()):
            try:
                arrays.append(F.transform(fn(), _numbered(i)))
            except Exception as error:
                self._note(name, error)
        rest = ["type", "detector", "ord", "confidence", "term", "body", "kind"]
        if arrays:
            # The outer form: for the plain one Spark first filters by the size of the array and so finds all hits again.
            hits = nodes.select("doc_id", "node_id", "seq", F.concat(*arrays).alias("_hits"))
            exploded = hits.select("doc_id", "node_id", "seq", F.explode_outer("_hits").alias("h"))
            frames.append(exploded.where(F.col("h").isNotNull()).select("doc_id", "node_id", "seq", *[f"h.{c}" for c in rest], "h.emit"))
        for i, (name, fn) in enumerate(self.tables.items()):
            try:
                frames.append(fn(nodes).withColumn("emit", F.lit(len(self.columns) + i)))
            except Exception as error:
                self._note(name, error)
        if not frames:
            raise ValueError("no detector could be run")
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out


def default_annotator() -> Annotator:
    a = Annotator()
    for name, fn in (
        ("definition", detect_definitions), ("example", detect_examples), ("exercise", detect_exercises),
        ("objective", detect_objectives), ("summary", detect_summaries), ("callout", detect_callouts),
        ("cross_reference", detect_cross_refs), ("key_term", key_term_candidates),
    ):
        a.register(name, fn)
    a.register("figure", figure_nearby_text, table=True)
    return a.register("equation", equation_nearby_text, table=True)


def annotate(nodes: DataFrame, annotator: Annotator | None = None) -> DataFrame:
    """All annotations of a corpus; key terms reduced to their first occurrence.

    ``nodes`` should be a stored table: it is read once for the one-node detectors, once
    for the key terms and once per association.
    """
    full = annotator or default_annotator()
    order = [*full.columns, *full.tables]
    terms = Annotator({k: v for k, v in full.columns.items() if k == "key_term"}, fail_fast=full.fail_fast)
    rest = Annotator({k: v for k, v in full.columns.items() if k != "key_term"}, full.tables, full.fail_fast)

    def renumbered(part: Annotator) -> DataFrame:
        at = F.array(*[F.lit(order.index(n)) for n in [*part.columns, *part.tables]])
        return part.run(nodes).withColumn("emit", F.element_at(at, F.col("emit") + 1))

    found = renumbered(rest)
    return found.unionByName(first_occurrence_terms(renumbered(terms))) if terms.columns else found


def dedupe_annotations(hits: DataFrame) -> DataFrame:
    """Per (type, node) the most confident hit, ties to the first emitted."""
    keys = ["doc_id", "node_id", "type"]
    rest = [c for c in hits.columns if c not in keys]
    rank = F.struct("confidence", (-F.col("emit")).alias("e"), (-F.col("ord")).alias("o"))
    return hits.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row")).select(*keys, "_row.*")
