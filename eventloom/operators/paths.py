"""Trigger paths: ordered filters with four-state outcomes, the language that selects on them, and the report over them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.patterns import expand, is_glob

PASS, FAIL, READY, EXCEPTION = "Pass", "Fail", "Ready", "Exception"
POLICIES = ("IgnoreCompletely", "Rethrow", "SkipEvent", "FailModule", "FailPath")


@dataclass(frozen=True)
class Entry:
    """A module on a path: its condition, `!` (veto) or `-` (ignore) before it, and a column with the category of its error or null."""

    label: str
    condition: Column = field(compare=False)
    action: str = ""
    error: Column | None = field(default=None, compare=False)

    def __post_init__(self):
        if self.action not in ("", "!", "-"):
            raise ValueError(f"unknown action {self.action!r}")


def outcome(entry: Entry, policy: Mapping[str, str], end_path: bool = False) -> Column:
    """pass, fail, exc or failpath of one module. Categories that the policy does not list are rethrown."""
    value = {"": entry.condition, "!": ~entry.condition, "-": F.lit(True)}[entry.action]
    plain = F.when(value, "pass").otherwise("fail")
    if entry.error is None:
        return plain
    if unknown := set(policy.values()) - set(POLICIES):
        raise ValueError(f"unknown policies {sorted(unknown)}")
    # On the end path a skipped event or failed path is only a failed module.
    does = {"IgnoreCompletely": "pass", "FailModule": "pass", "SkipEvent": "pass" if end_path else "exc", "FailPath": "pass" if end_path else "failpath"}
    out = F.raise_error(F.concat(F.lit(f"{entry.label}: "), entry.error)).cast("string")
    for category, action in policy.items():
        if action != "Rethrow":
            out = F.when(entry.error == category, does[action]).otherwise(out)
    return F.when(entry.error.isNull(), plain).otherwise(out)


def ran(entries: list[Entry], policy: Mapping[str, str], end_path: bool = False) -> Column:
    """The outcomes of the modules that run: one that does not pass is the last, and what stands behind it is not evaluated."""
    out = F.array().cast("array<string>")
    for e in reversed(entries):
        own = outcome(e, policy, end_path)
        out = F.when(own == "pass", F.concat(F.array(F.lit("pass")), out)).otherwise(F.array(own))
    return out


def run_paths(df: DataFrame, paths: Mapping[str, list[Entry]], policy: Mapping[str, str] | None = None, end_path: bool = False, process: str = "") -> DataFrame:
    """Adds for each path st_<path> (its state) and ix_<path>, and out_<path> (its modules' outcomes up to the deciding one).

    The index is the number of modules run; with an exception it is the place of the module that threw. A path without modules
    passes. A module behind one that does not pass is not run, so an error of it is not raised. With a process, columns are named
    st_<process>_<path> and so on. Everything is one projection of ordinary expressions.
    """
    policy = policy or {}
    for name, entries in paths.items():
        own = f"{process}_{name}" if process else name
        df = df.withColumn(f"out_{own}", ran(entries, policy, end_path))
        n, last = F.size(f"out_{own}"), F.coalesce(F.element_at(f"out_{own}", -1), F.lit("pass")) if entries else F.lit("pass")
        df = df.withColumns({
            f"st_{own}": F.when(last == "pass", PASS).when(last == "exc", EXCEPTION).otherwise(FAIL),
            f"ix_{own}": F.when(last == "exc", n - 1).otherwise(n).cast("long"),
        })
    return df


def accepted(names: list[str]) -> Column:
    """Whether any path passed."""
    return reduce(Column.__or__, [F.col(f"st_{n}") == PASS for n in names], F.lit(False))


def select_events(spec: list[str], names: list[str], process: str = "") -> Column:
    """A selection on path states as one boolean column over st_<path>, or st_<process>_<path>.

    `p` or a glob: a matched path passed; `!p`: it failed, and for a glob of several all failed; `exception@p`: a matched path threw;
    `&noexception` after either of the first two: and no path threw. Terms are alternatives. No terms, or `*`, `!*` and `exception@*`
    together, select all. Names that match nothing are errors, except that a positive glob selects nothing.
    """
    spec = ["".join(s.split()) for s in spec]
    if not spec or {"*", "!*", "exception@*"} <= set(spec):
        return F.lit(True)
    state = lambda n, v: F.col(f"st_{process}_{n}" if process else f"st_{n}") == v
    any_of = lambda cs: reduce(Column.__or__, cs, F.lit(False))
    threw = any_of([state(n, EXCEPTION) for n in names])
    terms = []
    for s in spec:
        body, amp, tail = s.partition("&")
        if amp and tail != "noexception":
            raise ValueError(f"only &noexception may follow a name: {s!r}")
        negated = body.startswith("!")
        name = body[negated:]
        if "exception@" in name:
            if negated or amp or not name.startswith("exception@"):
                raise ValueError(f"exception@ stands alone before a name: {s!r}")
            name, wanted = name[len("exception@") :], EXCEPTION
        else:
            wanted = FAIL if negated else PASS
        found = expand(name, names)
        if not found and (negated or not is_glob(name)):
            raise ValueError(f"no path is called {name!r}")
        hits = [state(n, wanted) for n in found]
        term = reduce(Column.__and__, hits) if negated else any_of(hits)
        terms.append(term & ~threw if amp else term)
    return any_of(terms)


def wanted(names: list[str], select: list[str] = (), reject: list[str] = ()) -> Column:
    """Selected, or nothing is asked for; and not rejected."""
    out = select_events(list(select), names) if select else F.lit(True)
    return out & ~select_events(list(reject), names) if reject else out


def by_process(spec: list[str], processes: Mapping[str, list[str]], own: str) -> Column:
    """Selections `process:spec`, those of one process together and any process enough; without a process they are of `own`.

    processes: the paths of each; digits before a colon are a path id and no process.
    """
    groups: dict[str, list[str]] = {}
    for s in spec:
        head, colon, tail = s.partition(":")
        named = colon and not head.strip().isdigit() and "@" not in head
        groups.setdefault(head.strip() if named else own, []).append(tail if named else s)
    if unknown := set(groups) - set(processes):
        raise ValueError(f"unknown processes {sorted(unknown)}")
    return reduce(Column.__or__, [select_events(specs, processes[p], p) for p, specs in groups.items()], F.lit(False))


def wanted_by_process(processes: Mapping[str, list[str]], own: str, select: list[str] = (), reject: list[str] = ()) -> Column:
    """wanted() over the path states of several processes."""
    out = by_process(list(select), processes, own) if select else F.lit(True)
    return out & ~by_process(list(reject), processes, own) if reject else out


def path_report(df: DataFrame, names: list[str]) -> DataFrame:
    """(path_id, path, n_run, n_passed, n_failed, n_error): one pass with counters side by side, and a row for each path at the end."""
    count = lambda c: F.count_if(c).cast("long")
    sums = df.agg(*[count(F.col(f"st_{n}") == s).alias(f"{s}_{n}") for n in names for s in (PASS, FAIL, EXCEPTION)])
    rows = [F.struct(F.lit(k).cast("long").alias("path_id"), F.lit(n).alias("path"), (F.col(f"{PASS}_{n}") + F.col(f"{FAIL}_{n}") + F.col(f"{EXCEPTION}_{n}")).alias("n_run"), F.col(f"{PASS}_{n}").alias("n_passed"), F.col(f"{FAIL}_{n}").alias("n_failed"), F.col(f"{EXCEPTION}_{n}").alias("n_error")) for k, n in enumerate(names)]
    return sums.select(F.inline(F.array(*rows)))


def module_report(df: DataFrame, paths: Mapping[str, list[Entry]]) -> DataFrame:
    """(path, place, label, n_visited, n_passed, n_failed, n_error) of each module on each path."""
    aggs, rows = [], []
    for n, entries in paths.items():
        for k, e in enumerate(entries):
            o = F.get(f"out_{n}", F.lit(k))
            for s, test in (("v", o.isNotNull()), ("p", o == "pass"), ("f", o.isin("fail", "failpath")), ("x", o == "exc")):
                aggs.append(F.count_if(test).cast("long").alias(f"{s}{k}_{n}"))
            rows.append(F.struct(F.lit(n).alias("path"), F.lit(k).cast("long").alias("place"), F.lit(e.label).alias("label"), F.col(f"v{k}_{n}").alias("n_visited"), F.col(f"p{k}_{n}").alias("n_passed"), F.col(f"f{k}_{n}").alias("n_failed"), F.col(f"x{k}_{n}").alias("n_error")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def module_totals(df: DataFrame, paths: Mapping[str, list[Entry]], policy: Mapping[str, str] | None = None) -> DataFrame:
    """(label, n_visited, n_run, n_passed, n_failed, n_error) of each module over all paths.

    A module that several paths hold is visited by each but runs once an event, with its own result before `!` and `-`. A failed module
    of the error policy counts as failed, an ignored error as passed.
    """
    places: dict[str, list[tuple[str, int, Entry]]] = {}
    for n, entries in paths.items():
        for k, e in enumerate(entries):
            places.setdefault(e.label, []).append((n, k, e))
    aggs, rows = [], []
    for m, (label, at) in enumerate(places.items()):
        visits = [F.get(f"out_{n}", F.lit(k)).isNotNull() for n, k, _ in at]
        ran, e = reduce(Column.__or__, visits), at[0][2]
        does = F.lit("none")
        if e.error is not None:
            does = F.when(e.error.isNull(), "none").otherwise("Rethrow")
            for category, action in (policy or {}).items():
                does = F.when(e.error == category, action).otherwise(does)
        passed, failed = (does == "IgnoreCompletely") | (does == "none") & e.condition, (does == "FailModule") | (does == "none") & ~e.condition
        tests = {"visited": None, "run": ran, "passed": ran & passed, "failed": ran & failed, "error": ran & ~does.isin("none", "IgnoreCompletely", "FailModule")}
        for name, test in tests.items():
            count = F.count_if(test) if test is not None else reduce(Column.__add__, [F.count_if(v) for v in visits])
            aggs.append(count.cast("long").alias(f"{name}{m}"))
        rows.append(F.struct(F.lit(label).alias("label"), *[F.col(f"{name}{m}").alias(f"n_{name}") for name in tests]))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def event_totals(df: DataFrame, names: list[str]) -> DataFrame:
    ok = accepted(names)
    return df.agg(F.count("*").alias("n_events"), F.count_if(ok).cast("long").alias("n_passed"), F.count_if(~ok).cast("long").alias("n_failed"))
