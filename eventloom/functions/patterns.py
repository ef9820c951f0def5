"""Small text languages: globs, event-id patterns, product rules, path specs, tags, file-name patterns. All run at plan time."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 2**32 - 1


def glob_regex(glob: str) -> str:
    """`*` is any text, `?` any character, the rest is literal."""
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)


def is_glob(text: str) -> bool:
    return "*" in text or "?" in text


def expand(glob: str, names: Iterable[str]) -> list[str]:
    """Names that match; a leading `digits:` in the glob is an id and left aside."""
    pattern = re.compile(glob_regex(re.sub(r"^\d+:", "", glob)))
    return [n for n in names if pattern.fullmatch(n)]


def id_field(column: Column, text: str) -> Column:
    """One field of an event-id pattern: `*`, numbers and inclusive ranges, comma-separated."""
    parts = []
    for piece in text.split(","):
        piece = piece.strip()
        if piece == "*":
            return F.lit(True)
        if m := re.fullmatch(r"(\d+)-(\d+)", piece):
            lo, hi = int(m[1]), int(m[2])
            if lo > hi:
                raise ValueError(f"empty range {piece}")
            parts.append(column.between(lo, hi))
        elif piece.isdigit():
            parts.append(column == int(piece))
        else:
            raise ValueError(f"not an id pattern: {piece!r}")
    return reduce(Column.__or__, parts)


def match_ids(patterns: Iterable[str], run: str = "run", subrun: str = "subrun", event: str = "event") -> Column:
    """Column that is true for events matching any `run:subrun:event` pattern; comparisons only, so they reach the scan."""
    out = F.lit(False)
    for p in patterns:
        fields = p.split(":")
        if len(fields) != 3:
            raise ValueError(f"an event-id pattern has three fields: {p!r}")
        out = out | reduce(Column.__and__, [id_field(F.col(c), f) for c, f in zip((run, subrun, event), fields)])
    return out


def parse_start(text: str) -> tuple[int, int, int]:
    """`r`, `r:s` or `r:s:e` with blanks around fields. Run 0 and the largest u32 are invalid; an absent subrun is 0, an absent event 1."""
    fields = [x.strip() for x in text.split(":")]
    if not 1 <= len(fields) <= 3 or not all(re.fullmatch(r"\d+", x) for x in fields):
        raise ValueError(f"not an event id: {text!r}")
    numbers = [int(x) for x in fields]
    if any(n >= U32 for n in numbers) or numbers[0] == 0 or len(numbers) == 3 and numbers[2] == 0:
        raise ValueError(f"event id out of range: {text!r}")
    return tuple(numbers + [0, 1][len(numbers) - 1 :])[:3]


def from_start(text: str) -> Column:
    r, s, e = parse_start(text)
    return (F.col("run") > r) | (F.col("run") == r) & ((F.col("subrun") > s) | (F.col("subrun") == s) & (F.col("event") >= e))


@dataclass(frozen=True)
class InputTag:
    """label[:instance[:process]]."""

    label: str
    instance: str = ""
    process: str = ""

    @classmethod
    def parse(cls, text: str) -> InputTag:
        fields = text.split(":")
        if len(fields) > 3 or not fields[0]:
            raise ValueError(f"not an input tag: {text!r}")
        return cls(*fields)

    def __str__(self) -> str:
        return ":".join([self.label, self.instance, self.process]).rstrip(":")


@dataclass(frozen=True)
class PathSpec:
    """[id:]name."""

    name: str
    bit: int | None = None

    @classmethod
    def parse(cls, text: str) -> PathSpec:
        text = "".join(text.split())
        if m := re.fullmatch(r"(\d+):(.+)", text):
            return cls(m[2], int(m[1]))
        if not text or ":" in text:
            raise ValueError(f"not a path specification: {text!r}")
        return cls(text)


@dataclass(frozen=True)
class Rule:
    """keep|drop of a product pattern type_label_instance_process, on one level or all."""

    keep: bool
    fields: tuple[str, str, str, str]
    level: str | None = None

    LEVELS = {"inEvent": "Event", "inSubRun": "SubRun", "inRun": "Run", "inResults": "Results"}

    @classmethod
    def parse(cls, text: str) -> Rule:
        m = re.fullmatch(r"\s*(keep|drop)\s+(\S+)(?:\s+(\S+))?\s*", text)
        if not m:
            raise ValueError(f"not a rule: {text!r}")
        if m[3] is not None and m[3] not in cls.LEVELS:
            raise ValueError(f"unknown level {m[3]!r}")
        fields = ("*",) * 4 if m[2] == "*" else tuple(m[2].split("_"))
        allowed = [r"[\w:*?<>,]*", r"[\w\-*?]*", r"[\w*?]*", r"[\w*?]*"]
        if len(fields) != 4 or not all(re.fullmatch(a, f) for a, f in zip(allowed, fields)):
            raise ValueError(f"a product pattern has four fields of names and wildcards: {m[2]!r}")
        return cls(m[1] == "keep", fields, cls.LEVELS.get(m[3]))

    def matches(self) -> Column:
        names = ("friendly_class", "module_label", "instance", "process")
        tests = [F.col(n).rlike(f"^(?:{glob_regex(f)})$") for n, f in zip(names, self.fields) if f != "*"]
        if self.level:
            tests.append(F.col("level") == self.level)
        return reduce(Column.__and__, tests, F.lit(True))


def kept(rules: Iterable[str] = ("keep *",)) -> Column:
    """The verdict of the last rule that matches, dropped if none does; transient and dropped products are never kept."""
    out = F.lit(False)
    for r in map(Rule.parse, rules):
        out = F.when(r.matches(), r.keep).otherwise(out)
    return out & ~F.col("transient") & ~F.col("dropped")


COUNTER = r"%(0?\d+)?#"
#: What a conversion of a file-name pattern reads from the statistics of the file. The letters.
NUMBERS = {"r": "lowest_run", "R": "highest_run", "s": "lowest_subrun", "S": "highest_subrun"}
NAMES = {"l": "label", "p": "process"}
TIMES = {"o": "opened", "c": "closed", "r": "lowest_run_time", "R": "highest_run_time", "s": "lowest_subrun_time", "S": "highest_subrun_time"}
UNKNOWN = "-"


def _of_input(source: str) -> dict[str, str]:
    """The parts of an input file's name: b without folder and extension, n without folder, e extension, d folder, p all of it."""
    folder, _, name = source.rpartition("/")
    stem, dot, ext = name.rpartition(".")
    return {"b": stem if dot else name, "n": name, "e": dot + ext if dot else "", "d": folder, "p": source}


def _scan(pattern: str, stats: Mapping) -> Iterable[str]:
    """The pieces of a filled pattern, from left to right; a conversion that is not known is an error."""
    source, at = stats.get("input_file") or "", 0

    def one(letters: Iterable[str], what: str) -> str:
        nonlocal at
        if at >= len(pattern) or pattern[at] not in letters:
            raise ValueError(f"unknown conversion {what}{pattern[at : at + 1]!r} at {at} of {pattern!r}")
        at += 1
        return pattern[at - 1]

    def up_to_percent() -> str:
        nonlocal at
        end = pattern.find("%", at)
        if end < 0:
            raise ValueError(f"an edit of the input name is not closed in {pattern!r}")
        text, at = pattern[at:end], end + 1
        return text

    while (k := pattern.find("%", at)) >= 0:
        yield pattern[at:k]
        at = k + 1
        fill = ""
        while at < len(pattern) and pattern[at].isdigit():
            fill, at = fill + pattern[at], at + 1
        c = one([*NUMBERS, "#"] if fill else [*NUMBERS, *NAMES, "#", "t", "i"], "")
        if c == "#":
            yield f"%{fill}#"  # filled when the names of all files are known
        elif c == "t":
            v = stats.get(TIMES[one(TIMES, "t")])
            yield UNKNOWN if v is None else v.strftime("%Y%m%dT%H%M%S")
        elif c == "i":
            one("f", "i")
            part = one("bnedps", "if")
            if part != "s":
                yield _of_input(source)[part] or UNKNOWN
                continue
            one("%", "ifs")
            old, new, flags = up_to_percent(), up_to_percent(), up_to_percent()
            if set(flags) - set("ig"):
                raise ValueError(f"unknown flags {flags!r} in {pattern!r}")
            new = re.sub(r"\$(\d)", r"\\\1", new)
            yield re.sub(old, new, source, count=0 if "g" in flags else 1, flags=re.I if "i" in flags else 0) or UNKNOWN
        elif c in NAMES:
            v = stats.get(NAMES[c])
            yield UNKNOWN if v is None else str(v)
        else:
            v = stats.get(NUMBERS[c])
            yield UNKNOWN if v is None else str(v).rjust(int(fill or 0), "0")
    yield pattern[at:]


def substituted(pattern: str, stats: Mapping) -> str:
    """Substitutes a file-name pattern, all but `%#`, from one row of file statistics.

    %l label, %p process, %r/%R and %s/%S lowest and highest run and subrun (optionally filled, `%05r`), %to/tc/tr/tR/ts/tS times,
    %if[bnedp] parts of the input name, %ifs%regex%text%[ig]% an edited input name; unknown values are `-`, unknown conversions errors.
    """
    return "".join(_scan(pattern, stats))


def file_name(pattern: str, stats: Mapping, counters: dict[str, int] | None = None) -> str:
    """The whole name: `%#` is the number of earlier files whose name is the same otherwise."""
    name = substituted(pattern, stats)
    counter = re.search(COUNTER, name)
    if counter:
        counters = {} if counters is None else counters
        n = counters.get(name, 0)
        counters[name] = n + 1
        name = name[: counter.start()] + str(n).rjust(int(counter[1] or 0), "0") + name[counter.end() :]
    return name


def check_counter(pattern: str, closes_on_properties: bool) -> None:
    """Output that can switch files needs `%#` in its name."""
    if closes_on_properties and not re.search(COUNTER, pattern):
        raise ValueError("a file name without %# cannot tell several files apart")
