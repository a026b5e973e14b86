"""Imperfect copies of items: the edits that texts undergo on the web, as known ground truth.

A spec is a kind and, where it needs one, an intensity: the share of words edited (word_delete, word_substitute), the share of
the item kept (truncate), the share of numbers changed (number_change, all by default), or the number of breaks
(html_split).  Edits without chance are column expressions; the others draw from a stream seeded by the seed, the spec and the
item, so that no record depends on any other.  An edit that does not apply to an item gives null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidsieve.functions.hashing import stream
from braidsieve.operators.items import rendered

# The kinds, and those that need an intensity.
KINDS = ("verbatim", "format_noise", "punct_delete", "choice_shuffle", "labelled_dot", "labelled_paren", "number_change", "word_delete", "word_substitute", "truncate", "html_wrap", "html_split")
GRADED = ("word_delete", "word_substitute", "truncate", "html_split")


# What an intensity of each graded kind must be.
_WITHIN = {kind: (lambda x: 0 <= x <= 1, "a share within [0, 1]") for kind in KINDS} | {"html_split": (lambda x: x >= 1 and x == int(x), "a whole number of breaks")}


@dataclass(frozen=True)
class Spec:
    kind: str
    intensity: float | None = None

    def __post_init__(self) -> None:
        if self.kind not in _WITHIN:
            raise ValueError(f"there is no edit {self.kind!r}")
        fits, what = _WITHIN[self.kind]
        missing = self.intensity is None and self.kind in GRADED
        if missing or not (self.intensity is None or fits(self.intensity)):
            raise ValueError(f"{self.kind} needs {what}, not {self.intensity}")

    @property
    def label(self) -> str:
        return self.kind if self.intensity is None else f"{self.kind}@{self.intensity:g}"


# The 20 conditions of an evaluation.
CONDITIONS = """
verbatim
format_noise
punct_delete
word_delete 0.05
word_delete 0.1
word_delete 0.2
word_delete 0.3
word_substitute 0.05
word_substitute 0.1
word_substitute 0.2
word_substitute 0.3
truncate 0.8
truncate 0.6
number_change
choice_shuffle
labelled_dot
labelled_paren
html_wrap
html_split 1
html_split 3
"""


def default_specs() -> list[Spec]:
    """The conditions of ``CONDITIONS``."""
    return [Spec(kind, float(x) if x else None) for kind, _, x in (line.partition(" ") for line in CONDITIONS.split("\n") if line)]


# ---------------------------------------------------------------- edits without chance


def _labelled(template: str) -> Column:
    lines = F.transform("choices", lambda c, i: F.format_string(template, F.char(F.lit(65) + i), c))
    return F.when(F.size("choices") > 0, F.concat_ws("\n", F.coalesce("question", F.lit("")), lines))


def _truncated(keep: float) -> Column:
    words = F.regexp_extract_all(rendered(), F.lit(r"(?U)\s*\S+"), F.lit(0))
    return F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, F.greatest(F.lit(1), F.rint(F.size(words) * keep).cast("int"))), ""))


def _without_marks() -> Column:
    less = F.regexp_replace(rendered(), r"\p{P}", "")
    return F.when(less != rendered(), less)


# ---------------------------------------------------------------- edits by chance

_WORD = re.compile(r"\S+")
# Fixed value: what counts as one number.
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_GAPS = (" ", "   ", "\t", " ", "\n", "  ")
_MARKS = ",;:!?\"')"
_PAGES = (
    "<main>\n<ul><li>Start</li><li>Archive</li></ul>\n<p>{}</p>\n<small>All texts by their authors.</small>\n</main>",
    "<section><h3>Exercise</h3>\n<p>{}</p>\n<a>Next</a></section>",
    "<table><tr><td>{}</td></tr>\n<tr><td>Advertisement</td></tr></table>",
)
_FILLERS = "above across along among around away back below best better called came change city close come country cut day different does done down early earth end enough ever eyes far feet few food form four gave give good got group grow hand hard head help high".split()


def _render(question: str, choices: list[str]) -> str:
    return "\n".join([question, *choices])


def _noise(text: str, rng) -> str:
    case = (str.upper, str.lower, str.title)[rng.randrange(3)]
    noisy = _WORD.sub(lambda m: case(m[0]) + (_MARKS[rng.randrange(len(_MARKS))] if rng.random() < 0.15 else ""), text)
    return re.sub(r"[^\S\n]+", lambda _: _GAPS[rng.randrange(len(_GAPS))], noisy)


def _shuffle(question: str, choices: list[str], rng) -> str | None:
    if len(set(choices)) < 2:
        return None
    new = list(choices)
    while new == choices:
        rng.shuffle(new)
    return _render(question, new)


def _numbers(text: str, share: float, rng) -> str | None:
    places = [m.span() for m in _NUMBER.finditer(text)]
    if not places:
        return None
    for a, b in rng.sample(places, min(len(places), max(1, round(share * len(places))))):
        digits = [i for i in range(a, b) if text[i].isdigit()]
        drawn = {i: str(rng.randrange(10)) for i in digits}
        if all(text[i] == d for i, d in drawn.items()):
            drawn[digits[0]] = str((int(drawn[digits[0]]) + 1 + rng.randrange(8)) % 10)
        text = "".join(drawn.get(i, c) for i, c in enumerate(text))
    return text


def _words(text: str, rate: float, rng, substitute: bool) -> str:
    hit = [rng.random() < rate for _ in _WORD.finditer(text)]
    if hit and all(hit) and not substitute:
        hit[rng.randrange(len(hit))] = False
    turn = iter(hit)

    def edit(m: re.Match[str]) -> str:
        if not next(turn):
            return m[0]
        return rng.choice([f for f in _FILLERS if f != m[0].lower()]) if substitute else ""

    return _WORD.sub(edit, text)


def _breaks(text: str, count: int, rng) -> str | None:
    starts = [m.start() for m in _WORD.finditer(text)][1:]
    if not starts:
        return None
    for at in sorted(rng.sample(starts, min(count, len(starts))), reverse=True):
        text = f"{text[:at]}\n<br />\n{text[at:]}"
    return text


def by_chance(spec: Spec, question: str, choices: list[str], rng) -> str | None:
    """One edited text of a kind that draws by chance."""
    text = _render(question, choices)
    if spec.kind == "format_noise":
        return _noise(text, rng)
    if spec.kind == "choice_shuffle":
        return _shuffle(question, choices, rng)
    if spec.kind == "number_change":
        return _numbers(text, 1.0 if spec.intensity is None else spec.intensity, rng)
    if spec.kind in ("word_delete", "word_substitute"):
        return _words(text, spec.intensity, rng, spec.kind == "word_substitute")
    if spec.kind == "html_wrap":
        return _PAGES[rng.randrange(len(_PAGES))].replace("{}", text)
    if spec.kind == "html_split":
        return _breaks(text, int(spec.intensity), rng)
    raise ValueError(f"{spec.kind} draws nothing")


def corrupted(spec: Spec, seed: int = 0) -> Column:
    """The edited text of each item row; null where the edit does not apply."""
    fixed = {
        "verbatim": rendered,
        "punct_delete": _without_marks,
        "labelled_dot": lambda: _labelled("%s. %s"),
        "labelled_paren": lambda: _labelled("(%s) %s"),
        "truncate": lambda: _truncated(spec.intensity),
    }
    if spec.kind in fixed:
        return fixed[spec.kind]()

    @F.arrow_udf(T.StringType())
    def run(item: pa.Array, question: pa.Array, choices: pa.Array) -> pa.Array:
        rows = zip(item.to_pylist(), question.to_pylist(), choices.to_pylist())
        return pa.array([by_chance(spec, q or "", [c for c in (cs or []) if c is not None], stream(seed, "plant", spec.label, i or "")) for i, q, cs in rows], pa.string())

    return run("item_id", "question", "choices")


def corrupt_all(items: DataFrame, specs: list[Spec], seed: int = 0) -> DataFrame:
    """(item_id, spec, kind, intensity, planted): every edit that applies and leaves some text."""
    each = F.array(*[F.struct(F.lit(s.label).alias("spec"), F.lit(s.kind).alias("kind"), F.lit(s.intensity).cast("double").alias("intensity"), corrupted(s, seed).alias("planted")) for s in specs])
    return items.select("item_id", F.explode(each).alias("e")).select("item_id", "e.*").where("planted is not null and planted rlike '(?U)\\\\S'")
