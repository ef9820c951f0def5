"""Workflow configuration: which paths and modules a job has, checked and pruned before anything is built."""

from __future__ import annotations

from dataclasses import dataclass, field

from eventloom.functions.patterns import PathSpec, parse_start

TABLES = ("producers", "filters", "analyzers")
NIL = "@nil"


@dataclass
class Workflow:
    """The outcome: trigger paths in order with their ids, the merged end path, and what is used."""

    trigger: list[tuple[int, str, list[str]]]
    end: list[str]
    modules: dict[str, str]
    unused_paths: list[str] = field(default_factory=list)
    unused_modules: list[str] = field(default_factory=list)
    process_name: str = "DUMMY"

    def summary(self, detail: str = "detailed") -> list[tuple[str, str, str]]:
        """(what, name, value) rows: brief has counts, detailed the paths and modules, full what is unused too."""
        if detail == "brief":
            return [("process", "name", self.process_name), ("count", "trigger_paths", str(len(self.trigger))), ("count", "end_path", str(len(self.end))), ("count", "modules", str(len(self.modules)))]
        if detail not in ("detailed", "full"):
            raise ValueError(f"unknown detail {detail!r}")
        rows = [("trigger_path", f"{bit}:{name}", " ".join(entries)) for bit, name, entries in self.trigger]
        rows += [("end_path", "end_path", " ".join(self.end))] + [("module", k, v) for k, v in sorted(self.modules.items())]
        if detail == "full":
            rows += [("unused_path", p, "") for p in self.unused_paths] + [("unused_module", m, "") for m in self.unused_modules]
        return rows


def bare(entry: str) -> str:
    return entry.lstrip("!-") if entry[:1] in "!-" else entry


def path_ids(specs: list[str]) -> list[PathSpec]:
    """Ordered specs with ids: the given one or the place in the list; `@nil` keeps a place empty."""
    out: list[PathSpec] = []
    for place, text in enumerate(specs):
        if text == NIL:
            continue
        spec = PathSpec.parse(text)
        spec = PathSpec(spec.name, place if spec.bit is None else spec.bit)
        for other in out:
            if (other.name == spec.name) != (other.bit == spec.bit):
                raise ValueError(f"path {spec.name} and id {spec.bit} do not belong to each other alone")
        if spec not in out:
            out.append(spec)
    return out


def compile_workflow(config: dict) -> Workflow:
    """Checks and prunes a configuration: {process_name, physics: {producers, filters, analyzers, trigger_paths, end_paths, <paths>}, outputs}."""
    physics = dict(config.get("physics", {}))
    name = config.get("process_name", "DUMMY")
    if "_" in name:
        raise ValueError("a process name has no underscore")
    kinds: dict[str, str] = {}
    for t, modules in [(t, physics.pop(t, {})) for t in TABLES] + [("outputs", config.get("outputs", {}))]:
        for label in modules:
            if label in kinds:
                raise ValueError(f"{label} is in {kinds[label]} and in {t}")
            if "_" in label:
                raise ValueError(f"a module label has no underscore: {label}")
            kinds[label] = t
    trigger_specs, end_specs = physics.pop("trigger_paths", None), physics.pop("end_paths", None)
    for key, value in physics.items():
        if not isinstance(value, list):
            raise ValueError(f"physics.{key} is no path")
    modifies: dict[str, bool] = {}
    for path, entries in physics.items():
        own = set()
        for e in entries:
            label = bare(e)
            if label not in kinds:
                raise ValueError(f"{path}: module {label} is not configured")
            if e != label and kinds[label] != "filters":
                raise ValueError(f"{path}: only filters take {e[0]}")
            own.add(kinds[label] in ("producers", "filters"))
        if len(own) > 1:
            raise ValueError(f"{path} mixes modifiers and observers")
        if own:
            modifies[path] = own.pop()
    for specs, wanted in ((trigger_specs, True), (end_specs, False)):
        for s in specs or []:
            if s != NIL and (n := PathSpec.parse(s).name) not in physics:
                raise ValueError(f"unknown path {n}")
            if s != NIL and modifies.get(n, wanted) != wanted:
                raise ValueError(f"{n} is a path of the other kind")
    default = sorted(p for p, m in modifies.items() if m)
    trigger = [(s.bit, s.name, physics[s.name]) for s in path_ids(trigger_specs if trigger_specs is not None else default) if s.name in modifies]
    ends = [PathSpec.parse(s).name for s in end_specs if s != NIL] if end_specs is not None else sorted(p for p, m in modifies.items() if not m)
    end = list(dict.fromkeys(e for p in ends for e in physics[p]))
    used = {bare(e) for _, _, es in trigger for e in es} | {bare(e) for e in end}
    taken = {n for _, n, _ in trigger} | set(ends)
    return Workflow(trigger, end, {k: v for k, v in kinds.items() if k in used}, sorted(set(physics) - taken), sorted(set(kinds) - used), name)


def route_outputs(outputs: list[str], options: list[str]) -> dict[str, str]:
    """Output label -> file from `-o [label:]file` options; only the first may leave out the label."""
    out: dict[str, str] = {}
    for k, o in enumerate(options):
        label, sep, file = o.partition(":")
        if not sep:
            if k:
                raise ValueError("only the first output may leave out its label")
            label, file = (outputs[0] if outputs else "out"), o
        if label in out:
            raise ValueError(f"output {label} has two files")
        out[label] = file
    return out


DEFAULT = "_default"
REQUIRED = ("application_family", "application_version", "group")
EXCLUSIVE = {"file_type": ("inherit_metadata", "inherit_file_type"), "run_type": ("inherit_metadata", "inherit_run_type")}


def by_label(options: list[str]) -> dict[str, str]:
    """`label:value` options, a value without a label under DEFAULT; later ones win."""
    out: dict[str, str] = {}
    for o in options:
        label, colon, value = o.partition(":")
        if ":" in value:
            raise ValueError(f"more than one colon in {o!r}")
        out[label if colon else DEFAULT] = value if colon else label
    return out


def catalog_metadata(outputs: dict[str, dict], tiers: list[str] = (), streams: list[str] = (), **given: str) -> dict[str, dict]:
    """Catalog metadata for each output: data tier and stream name from `label:value` options, then its own configuration, then the default;
    a stream is called like its output if nothing says otherwise. given: the job's other values, of which REQUIRED have to be there
    and EXCLUSIVE ones may not be given together."""
    for first, others in EXCLUSIVE.items():
        for other in others:
            if given.get(first) and given.get(other):
                raise ValueError(f"{first} and {other} exclude each other")
    if not outputs:
        return {}
    if missing := [k for k in REQUIRED if not given.get(k)]:
        raise ValueError(f"catalog metadata is incomplete: {missing}")
    tier, stream = by_label(list(tiers)), by_label(list(streams))
    if unknown := (set(tier) | set(stream)) - set(outputs) - {DEFAULT}:
        raise ValueError(f"options for unknown outputs {sorted(unknown)}")
    out = {}
    for label, own in outputs.items():
        values = {"data_tier": tier.get(label) or own.get("data_tier") or tier.get(DEFAULT), "stream_name": stream.get(label) or own.get("stream_name") or stream.get(DEFAULT) or label}
        if not values["data_tier"]:
            raise ValueError(f"output {label} has no data tier")
        out[label] = {**{k: v for k, v in given.items() if v}, **values}
    return out


def source_options(files: list[str] = (), file_list: list[str] = (), start: str | None = None, max_events: int | None = None, skip: int = 0) -> dict:
    """Options of a source: files or the lines of a list (not both), a start id, a limit and events to skip. Without files a source is
    empty and gives one event unless a limit is given."""
    if files and file_list:
        raise ValueError("files are given by name or by a list, not both")
    names = [*files, *[x for line in file_list if (x := line.split("#")[0].strip())]]
    if skip < 0:
        raise ValueError("events to skip are 0 or more")
    first = parse_start(start) if start is not None else None
    return {"kind": "files" if names else "empty", "files": names, "start": first, "max_events": max_events if max_events is not None else -1 if names else 1, "skip": skip}


def process_limits(max_events: int = -1, max_subruns: int = -1, report_frequency: int = 0) -> dict[str, int]:
    if report_frequency < 0:
        raise ValueError("a report frequency is 0 or more")
    return {"max_events": max_events, "max_subruns": max_subruns, "report_frequency": report_frequency}
