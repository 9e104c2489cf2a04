"""Rule files: YAML (or JSON) text with named groups of rules, read into typed rules; faults are told by line.

A file has a mapping ``rules`` from name to group.  A group has type, enabled (true if left out), description and, by its type:

* REQUIRED_FIELDS: fields.  DATE_FORMAT: fields, dateFormat.  ENUM_VALUES: rules, a mapping from field to allowedValues.
* BUSINESS_LOGIC: rules, a list of name, field and one of pattern, dataType or customValidator (a name in VALIDATORS).
* DUPLICATE_CHECK: rules, a list of condition and businessKey (a list of fields).
* MASTER_REFERENCE: references, a list of field, masterTable, masterColumn and condition.

A condition is ``field = value`` or ``field IN (value, ...)``.  Everything that is wrong with a file comes in one error, line by line.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .rules import Rule

#: Checks that a file names; a check gets a function from field name to Column and gives the condition for an error.
VALIDATORS: dict[str, Callable[[Callable[[str], Column]], Column]] = {}
_KINDS = {"REQUIRED_FIELDS": "fields", "DATE_FORMAT": "fields", "ENUM_VALUES": "rules", "BUSINESS_LOGIC": "rules", "DUPLICATE_CHECK": "rules", "MASTER_REFERENCE": "references"}
_CONDITION = re.compile(r"\s*(\w+)\s*(?:=\s*(.+?)|IN\s*\((.*)\))\s*", re.I | re.S)


class RuleFileError(ValueError):
    """What is wrong with a file: (line, message) each."""

    def __init__(self, faults: list[tuple[int, str]]):
        self.faults = sorted(faults)
        super().__init__("; ".join(f"line {n}: {text}" for n, text in self.faults))


@dataclass(frozen=True)
class Condition:
    """A field that has one of some values; without a field it always holds."""

    field: str = ""
    values: tuple[str, ...] = ()

    def column(self, of: Callable[[str], Column]) -> Column:
        return F.coalesce(of(self.field).cast("string").isin(*self.values), F.lit(False)) if self.field else F.lit(True)


@dataclass(frozen=True)
class Duplicate:
    condition: Condition
    key: tuple[str, ...]


@dataclass(frozen=True)
class Reference:
    field: str
    table: str
    column: str
    condition: Condition


@dataclass(frozen=True)
class Group:
    """Rules under one name.  row: functions from field lookup to Rule; fields: what the group asks for."""

    name: str
    kind: str
    enabled: bool
    row: tuple[Callable[[Callable[[str], Column]], Rule], ...] = ()
    duplicates: tuple[Duplicate, ...] = ()
    references: tuple[Reference, ...] = ()
    fields: tuple[str, ...] = ()


@dataclass
class _Reading:
    """Faults met so far, and values out of the nodes of a file."""

    faults: list[tuple[int, str]] = field(default_factory=list)

    def fault(self, node, text: str) -> None:
        self.faults.append((node.start_mark.line + 1, text))

    def mapping(self, node, what: str) -> dict:
        """Key -> node."""
        if node is None or node.id != "mapping":
            if node is not None:
                self.fault(node, f"{what} should be a mapping")
            return {}
        found: dict = {}
        for key, value in node.value:
            if key.value in found:
                self.fault(key, f"{key.value} is there twice")
            found[key.value] = value
        return found

    def items(self, node, what: str) -> list:
        if node is None or node.id != "sequence":
            if node is not None:
                self.fault(node, f"{what} should be a list")
            return []
        return node.value

    def text(self, node, what: str) -> str:
        if node.id != "scalar":
            self.fault(node, f"{what} should be a single value")
            return ""
        return node.value

    def texts(self, node, what: str) -> list[str]:
        return [self.text(n, what) for n in self.items(node, what)]

    def needed(self, parts: dict, names: tuple[str, ...], at, what: str) -> bool:
        for name in names:
            if name not in parts:
                self.fault(at, f"{what} lacks {name}")
        return all(n in parts for n in names)

    def condition(self, node) -> Condition:
        if node is None:
            return Condition()
        found = _CONDITION.fullmatch(self.text(node, "condition"))
        if not found:
            self.fault(node, f"not a condition: {node.value}")
            return Condition()
        name, one, several = found.groups()
        values = [one] if one is not None else several.split(",")
        return Condition(name, tuple(v.strip().strip("'\"") for v in values))


def parse(text: str) -> dict[str, Group]:
    """Groups of a rule file by name, in its order; raises RuleFileError."""
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading rule files needs PyYAML") from missing
    try:
        root = yaml.compose(text, Loader=yaml.SafeLoader)
    except yaml.MarkedYAMLError as broken:
        mark = broken.problem_mark or broken.context_mark
        raise RuleFileError([(mark.line + 1 if mark else 1, str(broken.problem))]) from broken
    reading = _Reading()
    top = reading.mapping(root, "a rule file") if root is not None else {}
    if root is None or "rules" not in top:
        raise RuleFileError([*reading.faults, (1, "there are no rules")])
    groups = {name: _group(reading, name, node) for name, node in reading.mapping(top["rules"], "rules").items()}
    if reading.faults:
        raise RuleFileError(reading.faults)
    return groups


def _group(reading: _Reading, name: str, node) -> Group:
    parts = reading.mapping(node, name)
    if not reading.needed(parts, ("type",), node, name):
        return Group(name, "", False)
    kind = reading.text(parts["type"], "type")
    on = reading.text(parts["enabled"], "enabled").lower() if "enabled" in parts else "true"
    if on not in ("true", "false"):
        reading.fault(parts["enabled"], f"enabled should be true or false: {on}")
    if kind not in _KINDS:
        reading.fault(parts["type"], f"unknown type of rule: {kind}")
        return Group(name, kind, False)
    if not reading.needed(parts, (_KINDS[kind],), node, name):
        return Group(name, kind, False)
    return _READ[kind](reading, name, parts, on == "true")


def _required(reading, name, parts, on) -> Group:
    fields = reading.texts(parts["fields"], "fields")
    make = lambda f: lambda of: Rule(name, rules.missing(of(f)), "REQUIRED_MISSING", f, of(f), f"{f} is required", "VAL001", rules.REQUIRED, on)
    return Group(name, "REQUIRED_FIELDS", on, tuple(map(make, fields)), fields=tuple(fields))


def bad_date(c: Column, form: str) -> Column:
    """Given, and not a day written in this form."""
    given, value = ~rules.is_blank(c), rules.trimmed(c)
    if form == "yyyy-MM-dd":
        return rules.bad_iso_date(c, strict=True)
    return given & F.try_to_timestamp(value, F.lit(form)).isNull()


def _dates(reading, name, parts, on) -> Group:
    form = reading.text(parts["dateFormat"], "dateFormat") if "dateFormat" in parts else "yyyy-MM-dd"
    fields = reading.texts(parts["fields"], "fields")
    make = lambda f: lambda of: Rule(name, bad_date(of(f), form), "INVALID_DATE", f, of(f), f"{f} is not a date", "VAL002", rules.DATE, on)
    return Group(name, "DATE_FORMAT", on, tuple(map(make, fields)), fields=tuple(fields))


def _enums(reading, name, parts, on) -> Group:
    made, fields = [], []
    for f, node in reading.mapping(parts["rules"], "rules").items():
        spec = reading.mapping(node, f)
        if reading.needed(spec, ("allowedValues",), node, f):
            allowed = reading.texts(spec["allowedValues"], "allowedValues")
            fields.append(f)
            made.append(lambda of, f=f, v=allowed: Rule(name, rules.not_among(of(f), v), "INVALID_ENUM", f, of(f), f"{f} is not an allowed value", "VAL003", rules.ENUM, on))
    return Group(name, "ENUM_VALUES", on, tuple(made), fields=tuple(fields))


def _business(reading, name, parts, on) -> Group:
    made, fields = [], []
    for node in reading.items(parts["rules"], "rules"):
        spec = reading.mapping(node, "a rule")
        if not reading.needed(spec, ("name", "field"), node, name):
            continue
        f, own = reading.text(spec["field"], "field"), reading.text(spec["name"], "name")
        said = reading.text(spec["description"], "description") if "description" in spec else own
        check = _business_check(reading, node, spec, f, own)
        if check is not None:
            fields.append(f)
            bad, kind, code, priority = check
            made.append(lambda of, b=bad, k=kind, f=f, s=said, c=code, p=priority: Rule(own, b(of), k, f, of(f), s, c, p, on))
    return Group(name, "BUSINESS_LOGIC", on, tuple(made), fields=tuple(fields))


def _business_check(reading, node, spec: dict, f: str, own: str):
    """(condition for an error, error type, code, priority) of a business rule."""
    given = [k for k in ("pattern", "dataType", "customValidator") if k in spec]
    if len(given) != 1:
        reading.fault(node, f"{own} should have one of pattern, dataType and customValidator")
        return None
    value = reading.text(spec[given[0]], given[0])
    if given[0] == "pattern":
        try:
            re.compile(value)
        except re.error as broken:
            reading.fault(spec["pattern"], f"not a pattern: {broken}")
        return lambda of: rules.not_like(of(f), value), "INVALID_PATTERN", "VAL007", rules.PATTERN
    if given[0] == "dataType":
        if value == "INTEGER_POSITIVE":
            return lambda of: rules.not_positive_whole(of(f)), "INVALID_NUMERIC", "VAL004", rules.NUMERIC
        if value.lower() in rules.CONVERTERS:
            return lambda of: rules.not_convertible(of(f), value.lower()), "DATA_TYPE", "VAL005", rules.NUMERIC
        reading.fault(spec["dataType"], f"unknown data type: {value}")
        return None
    if value not in VALIDATORS:
        reading.fault(spec["customValidator"], f"unknown validator: {value}")
        return None
    return VALIDATORS[value], "BUSINESS_RULE", "VAL006", rules.BUSINESS


def _duplicates(reading, name, parts, on) -> Group:
    found = []
    for node in reading.items(parts["rules"], "rules"):
        spec = reading.mapping(node, "a rule")
        if reading.needed(spec, ("businessKey",), node, name):
            found.append(Duplicate(reading.condition(spec.get("condition")), tuple(reading.texts(spec["businessKey"], "businessKey"))))
    asked = {f for d in found for f in (*d.key, d.condition.field) if f}
    return Group(name, "DUPLICATE_CHECK", on, duplicates=tuple(found), fields=tuple(sorted(asked)))


def _references(reading, name, parts, on) -> Group:
    found = []
    for node in reading.items(parts["references"], "references"):
        spec = reading.mapping(node, "a reference")
        if reading.needed(spec, ("field", "masterTable", "masterColumn"), node, name):
            f, table, column = (reading.text(spec[k], k) for k in ("field", "masterTable", "masterColumn"))
            found.append(Reference(f, table, column, reading.condition(spec.get("condition"))))
    return Group(name, "MASTER_REFERENCE", on, references=tuple(found), fields=tuple(r.field for r in found))


_READ = {
    "REQUIRED_FIELDS": _required, "DATE_FORMAT": _dates, "ENUM_VALUES": _enums, "BUSINESS_LOGIC": _business,
    "DUPLICATE_CHECK": _duplicates, "MASTER_REFERENCE": _references,
}
