"""Exact evaluation of rules on the candidates' bytes."""

from __future__ import annotations

import re
import struct
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlode.functions.encoding import widen
from gramlode.operators.index import Index
from gramlode.workers import reachable, written

from . import modules
from .execute import pruned
from .patterns import WORD, parse_regex, to_re
from .planner import Planner
from .rules import Node, Rule, RuleError, String, parse


class Unsupported(RuleError):
    """The condition needs what this matcher doesn't have (modules, xor, base64 and the like)."""


_MODIFIERS = frozenset({"xor", "base64", "base64wide"})


def patterns(string: String) -> list[tuple[re.Pattern, bool]]:
    """(compiled pattern, wide) of each variant of a string."""
    if string.modifiers & _MODIFIERS:
        raise Unsupported(f"{string.name}: xor and base64 strings")
    flags = re.S | (re.I if string.nocase else 0)
    out = []
    for use, wide in ((string.ascii, False), (string.wide, True)):
        if use:
            body = re.escape(widen(string.body) if wide else string.body) if string.kind == "text" else to_re(string.body, wide)
            out.append((re.compile(body, flags), wide))
    return out


def matches(string: String, data: bytes) -> list[tuple[int, int]]:
    """(offset, length) of the matches of a string, one for each offset, ascending; overlapping ones count."""
    found: dict[int, int] = {}
    for pattern, wide in patterns(string):
        at = 0
        while at <= len(data) and (m := pattern.search(data, at)) is not None:
            a, b = m.span()
            at = a + 1
            if b > a and not ("fullword" in string.modifiers and _joined(data, a, b, wide)):
                found.setdefault(a, b - a)
    return sorted(found.items())


def _joined(data: bytes, a: int, b: int, wide: bool) -> bool:
    if wide:
        return a >= 2 and data[a - 1] == 0 and data[a - 2] in WORD or b + 1 < len(data) and data[b + 1] == 0 and data[b] in WORD
    return a > 0 and data[a - 1] in WORD or b < len(data) and data[b] in WORD


_READ = {"int8": "b", "uint8": "B", "int16": "h", "uint16": "H", "int32": "i", "uint32": "I"}


class Matcher:
    """A rule on one sample. None is YARA's undefined value; a comparison with it is false."""

    def __init__(self, rule: Rule, data: bytes, others: dict[str, Rule] | None = None):
        self.rule, self.data, self.others = rule, data, others or {}
        self.named = Planner(rule).named
        self.found: dict[str, list[tuple[int, int]]] = {}
        self.current: list[str] = []
        self.variables: dict[str, int | None] = {}

    def of(self, name: str) -> list[tuple[int, int]]:
        if name == "$" and self.current:
            name = self.current[-1]
        if name not in self.found:
            self.found[name] = matches(self.named(Node("string", (name,)))[0], self.data)
        return self.found[name]

    def holds(self) -> bool:
        return bool(self.value(self.rule.condition))

    def within(self, name: str, how: str | None = None, place: Node | None = None) -> bool:
        if how == "at":
            at = self.value(place)
            return any(a == at for a, _ in self.of(name))
        if how == "in":
            low, high = map(self.value, place.args)
            return None not in (low, high) and any(low <= a <= high for a, _ in self.of(name))
        return bool(self.of(name))

    def enough(self, quantity: Node, n: int, total: int) -> bool:
        if quantity.kind == "any":
            return n >= 1
        if quantity.kind == "all":
            return n == total
        if quantity.kind == "none":
            return n == 0
        if quantity.kind == "percent":
            return n >= -(-total * self.value(quantity.args[0]) // 100)
        least = self.value(quantity)
        return least is not None and (n == 0 if least == 0 else n >= least)

    def value(self, node: Node):
        kind, args = node.kind, node.args
        if kind in ("bool", "int", "text", "float"):
            return args[0]
        if kind == "group":
            return self.value(args[0])
        if kind == "and":
            return all(self.value(x) for x in args)
        if kind == "or":
            return any(self.value(x) for x in args)
        if kind == "not":
            x = self.value(args[0])
            return None if x is None else not x
        if kind == "defined":
            return self.value(args[0]) is not None
        if kind == "filesize":
            return len(self.data)
        if kind == "string":
            return self.within(*args)
        if kind == "count":
            if len(args) == 1:
                return len(self.of(args[0]))
            low, high = map(self.value, args[1].args)
            return None if None in (low, high) else sum(low <= a <= high for a, _ in self.of(args[0]))
        if kind in ("offset", "length"):
            k, found = self.value(args[1]), self.of(args[0])
            return found[k - 1][kind == "length"] if k is not None and 1 <= k <= len(found) else None
        if kind == "of":
            strings = self.named(args[1])
            return self.enough(args[0], sum(self.within(s.name, *args[2:]) for s in strings), len(strings))
        if kind == "forof":
            return self.for_strings(*args)
        if kind == "forin":
            return self.for_values(*args)
        if kind == "neg":
            x = self.value(args[0])
            return None if x is None else -x
        if kind == "inv":
            x = self.value(args[0])
            return None if x is None else ~x
        if kind == "id":
            if args[0] in self.variables:
                return self.variables[args[0]]
            if args[0] in self.others:
                return Matcher(self.others[args[0]], self.data, self.others).holds()
            if modules.known(args[0]):
                return modules.value(args[0], self.data)
            raise Unsupported(f"{self.rule.name}: {args[0]}")
        if kind == "call":
            return self.call(*args)
        if kind == "op":
            return self.operation(*args)
        raise Unsupported(f"{self.rule.name}: {kind}")

    def for_strings(self, quantity: Node, _, over: Node, body: Node) -> bool:
        n, strings = 0, self.named(over)
        for s in strings:
            self.current.append(s.name)
            n += bool(self.value(body))
            self.current.pop()
        return self.enough(quantity, n, len(strings))

    def for_values(self, quantity: Node, names: tuple, over: Node, body: Node):
        if over.kind == "range":
            low, high = map(self.value, over.args)
            if None in (low, high):
                return None
            values = range(low, high + 1)
        elif over.kind == "set":
            values = [self.value(x) for x in over.args]
        else:
            raise Unsupported(f"{self.rule.name}: a loop over {over.kind}")
        if len(names) != 1:
            raise Unsupported(f"{self.rule.name}: a loop with several variables")
        n, before = 0, dict(self.variables)
        for v in values:
            self.variables[names[0]] = v
            n += bool(self.value(body))
        self.variables = before
        return self.enough(quantity, n, len(values))

    def call(self, function: Node, *arguments: Node):
        name = function.args[0] if function.kind == "id" else ""
        if name == "pe.exports" and len(arguments) == 1 and arguments[0].kind == "text":
            return modules.exports(arguments[0].args[0], self.data)
        big = name.endswith("be")
        if name.removesuffix("be") not in _READ or len(arguments) != 1:
            raise Unsupported(f"{self.rule.name}: {name or function.kind}()")
        code = (">" if big else "<") + _READ[name.removesuffix("be")]
        at = self.value(arguments[0])
        return struct.unpack_from(code, self.data, at)[0] if at is not None and 0 <= at <= len(self.data) - struct.calcsize(code) else None

    def operation(self, mark: str, left: Node, right: Node):
        a = self.value(left)
        if mark == "matches":
            tree = parse_regex(right.args[0], "s" in right.args[1])
            return None if a is None else re.compile(to_re(tree), re.S | (re.I if "i" in right.args[1] else 0)).search(a) is not None
        b = self.value(right)
        if a is None or b is None:
            return None
        if mark[0] == "i" and mark != "in":
            a, b, mark = a.lower(), b.lower(), mark[1:]
        texts = {"contains": lambda: b in a, "startswith": lambda: a.startswith(b), "endswith": lambda: a.endswith(b), "equals": lambda: a == b}
        if mark in texts:
            return texts[mark]()
        if mark in ("\\", "%") and b == 0:
            return None
        numbers = {
            "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "==": lambda: a == b, "!=": lambda: a != b,
            "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "\\": lambda: abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1), "%": lambda: a - b * (abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)),
            "&": lambda: a & b, "|": lambda: a | b, "^": lambda: a ^ b, "<<": lambda: a << b, ">>": lambda: a >> b,
        }
        return numbers[mark]()


def unsupported(rules: dict[str, Rule]) -> dict[str, str]:
    """Rules that this matcher can't evaluate, with the reason; a rule that uses one of them, or beside a global one, too."""

    def reason(rule: Rule, seen: tuple[str, ...] = ()) -> str | None:
        for s in rule.strings.values():
            if s.modifiers & _MODIFIERS:
                return f"{s.name}: xor and base64 strings"

        def walk(node, names: frozenset) -> str | None:
            if isinstance(node, tuple):
                return next((r for x in node if (r := walk(x, names))), None)
            if not isinstance(node, Node):
                return None
            kind, args = node.kind, node.args
            if kind == "forin":
                if len(args[1]) != 1 or args[2].kind not in ("range", "set"):
                    return "a loop over more than numbers"
                return walk(args[0], names) or walk(args[2], names) or walk(args[3], names | set(args[1]))
            if kind == "call":
                name = args[0].args[0] if args[0].kind == "id" else args[0].kind
                if name == "pe.exports" and len(args) == 2 and args[1].kind == "text" or name.removesuffix("be") in _READ and len(args) == 2:
                    return walk(args[1:], names)
                return f"{name}()"
            if kind == "id":
                if args[0] in names or modules.known(args[0]):
                    return None
                if args[0] in rules:
                    return None if args[0] in seen else reason(rules[args[0]], (*seen, args[0]))
                return args[0]
            return kind if kind in ("index", "member", "entrypoint") else walk(args, names)

        return walk(rule.condition, frozenset())

    own = {name: r for name, rule in rules.items() if (r := reason(rule, (name,)))}
    shared = next((f"global rule {name}: {r}" for name, r in own.items() if rules[name].is_global), None)
    return {name: own.get(name, shared) for name in rules if name in own or shared}


def _verify(rules: dict[str, Rule], skip: frozenset):
    general = [r for r in rules.values() if r.is_global]

    def run(batches):
        for batch in batches:
            out = []
            for fid, path, data, names in zip(*(batch.column(c).to_pylist() for c in ("fid", "path", "content", "rules"))):
                data = data or b""
                if any(not Matcher(g, data, rules).holds() for g in general if g.name not in skip):
                    continue
                out += [(name, fid, path, name not in skip) for name in names if name in skip or Matcher(rules[name], data, rules).holds()]
            columns = zip(*out) if out else ((), (), (), ())
            kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["rule", "fid", "path", "verified"])

    return run


#: Samples with candidates whose ids and rules are broadcast; more of them are shuffled with the contents.
BROADCAST_SAMPLES = 200_000


def _judge(found: DataFrame | None, whole: list[str], samples: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """(rule, fid, path, verified). Each sample is read once for all its rules; rules in `whole` are tried on all samples."""
    spark = reachable(samples.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    rows = samples.select("fid", "path", "content")
    if found is None:
        rows = rows.withColumn("rules", F.array(*map(F.lit, whole)).cast("array<string>")) if whole else rows.withColumn("rules", F.array().cast("array<string>")).limit(0)
    else:
        by = written(found.groupBy("fid").agg(F.collect_set("rule").alias("rules")), "candidates")  # no more entries than there are rules
        by = F.broadcast(by) if by.count() <= BROADCAST_SAMPLES else by
        rows = rows.join(by, "fid", "left" if whole else "inner")
        if whole:
            rows = rows.withColumn("rules", F.concat(F.coalesce("rules", F.array().cast("array<string>")), F.array(*map(F.lit, whole))))
    return rows.mapInArrow(_verify(rules, frozenset(unsupported(rules))), "rule string, fid long, path string, verified boolean")


def _verified(judged: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    for name, why in unsupported(rules).items():
        warnings.warn(f"rule {name} is not evaluated ({why}); `report` gives its candidates", stacklevel=3)
    return judged.where("verified").drop("verified")


def verify(found: DataFrame, samples: DataFrame, rules: dict[str, Rule] | str) -> DataFrame:
    """(rule, fid, path) of the candidates (rule, fid) whose samples match the rule. Rules that can't be evaluated are left out, with a warning."""
    rules = parse(rules) if isinstance(rules, str) else rules
    return _verified(_judge(found.select("rule", "fid"), [], samples, rules), rules)


def report(index: Index, samples: DataFrame, rules: dict[str, Rule] | str, **options) -> DataFrame:
    """(rule, fid, path, verified): all matches, and the candidates of rules that can't be evaluated, as not verified."""
    rules = parse(rules) if isinstance(rules, str) else rules
    return _judge(*pruned(index, rules, **options), samples, rules)


def scan(index: Index, samples: DataFrame, rules: dict[str, Rule] | str, **options) -> DataFrame:
    """(rule, fid, path) of all matches: candidates from the index, then verification. The options are those of `candidates`."""
    rules = parse(rules) if isinstance(rules, str) else rules
    return _verified(report(index, samples, rules, **options), rules)
