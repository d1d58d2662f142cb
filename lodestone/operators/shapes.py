"""Shapes of JSON files: which paths a profile admits, and which keys an object has at each of them.

A shape is a row of a policy: a path pattern, keys that all must be there, keys of which one must be, keys outside which
none may be, and strings of bounded length. The first shape whose path fits decides. Keys come from the parsed variant,
so that null members, nested objects and any order count as JSON has them; a repeated key is no JSON.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    path: str
    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    only: tuple[str, ...] = ()
    strings: dict[str, int] = field(default_factory=dict, hash=False)
    also: Callable[[Column], Column] | None = None


# Paths that every profile admits, places where JSON may be a list, and keys of which any file's object has one.
COMMON_PATHS = [
    r"(?:package|package-lock|tsconfig)\.json",
    r"tools/release/source-version\.json",
    r"workflow-templates/[a-z0-9][a-z0-9._-]*\.properties\.json",
    r"github/rulesets/[^/]+\.json",
    r"(?:.*/)?tsconfig\.[a-z0-9_.-]+\.json",
    r"(?:.*/)?\.?mcp\.json",
    r"(?:.*/)?\.?codex-plugin/plugin\.json",
    r"(?:.*/)?\.?agents/plugins/marketplace\.json",
]
LIST_PATHS = r"^(?:conformance/|tools/registry/capability-acceptance-checkpoints/|docs/reports/|packages/contracts/src/fixtures/)"
MARKERS = """
$id $schema bundleType capabilities compression compilerOptions contextWindowTokens defaultForAgents defaults dependencies description
darkPresetId displayName downloads entries entityType events files frameworks grantable historyBudget id images info initialState
items javaBinPath kind label lightPresetId manifest machines machineId maxRisk modelAlias module_id module_type name operations
packages profiles profileId provider protocolVersion openapi properties requiredScopes routes schema schemaVersion scripts selectionPolicy
serverUrl serviceId serviceName states strategies strategy targets templates tikaJarPath toolsets target_repositories type validation version
""".split()


def _get(json: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(json, path, kind)


def _is(json: Column, path: str, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(_get(json, path, "variant")).startswith(kind), F.lit(False))


def keys_of(json: Column) -> Column:
    """The keys of an object; null for anything else."""
    return F.map_keys(_get(json, "$", "map<string,variant>"))


def _sources(json: Column) -> Column:
    """A release's version sources: a list of objects of three exact kinds."""
    kinds = {("path", "pointer"): None, ("format", "key", "path"): "toml", ("format", "path", "pattern"): "regex"}

    def one(x: Column) -> Column:
        ok = F.lit(False)
        for keys, form in kinds.items():
            strings = [_is(x, f"$.{k}", "STRING") for k in keys]
            fits = F.array_sort(keys_of(x)) == F.array(*map(F.lit, sorted(keys)))
            for s in strings:
                fits = fits & s
            ok = ok | F.coalesce(fits & ((_get(x, "$.format", "string") == form) if form else F.lit(True)), F.lit(False))
        return ok

    items = _get(json, "$.versionSources", "array<variant>")
    said = _is(json, "$.changelog", "STRING") & _is(json, "$.tagPrefix", "STRING") & F.schema_of_variant(_get(json, "$.schemaVersion", "variant")).isin("BIGINT", "INT") & (_get(json, "$.schemaVersion", "int") == 1)
    return said & _is(json, "$.versionSources", "ARRAY") & (F.size(items) > 0) & F.forall(items, one)


#: Shapes of all profiles, in order; the last one is for all other paths.
COMMON = [
    Shape(r"tools/release/source-version\.json", ("schemaVersion", "versionSources", "changelog", "tagPrefix"), only=("schemaVersion", "versionSources", "changelog", "tagPrefix"), also=_sources),
    Shape(r"workflow-templates/[a-z0-9][a-z0-9._-]*\.properties\.json", ("name", "description"), only=("name", "description", "iconName", "categories", "filePatterns"), strings={"name": 160, "description": 320}),
    Shape(r"(?:.*/)?(?:\.?mcp|server)\.json", ("mcpServers",)),
    Shape(r"(?:.*/)?package(?:-lock)?\.json", any_of=("name", "version", "scripts", "dependencies", "devDependencies", "lockfileVersion", "packages")),
    Shape(r"(?:.*/)?tsconfig[^/]*\.json", any_of=("compilerOptions", "extends", "files", "include", "references")),
    Shape(r"contracts/.*\.schema\.json", ("$schema", "type")),
    Shape(r"policies/.*", any_of=("policyVersion", *MARKERS)),
    Shape(r"(?:artifacts|vendor)/.*", ("artifactVersion", "digest", "digestAlgorithm")),
    Shape(r"conformance/.*"),
    Shape(r"modules/[^/]+/module\.json", ("module_id", "module_type")),
    Shape(r"tools/registry/schema/.*\.schema\.json", ("$schema", "type", "properties")),
    Shape(r".*", any_of=tuple(MARKERS)),
]


def admitted(path: Column, paths: list[str]) -> Column:
    """Whether a profile admits JSON at the path, whatever its case."""
    return F.lower(path).rlike("(?s)^(?:" + "|".join(f"(?:{p})" for p in paths) + r")\z")


def _holds(shape: Shape, json: Column, keys: Column) -> Column:
    lits = lambda ks: F.array(*map(F.lit, ks))
    out = F.lit(True)
    if shape.all_of:
        out = out & (F.size(F.array_intersect(keys, lits(shape.all_of))) == len(set(shape.all_of)))
    if shape.any_of:
        out = out & F.arrays_overlap(keys, lits(shape.any_of))
    if shape.only:
        out = out & (F.size(F.array_except(keys, lits(shape.only))) == 0)
    for key, most in shape.strings.items():
        out = out & _is(json, f"$.{key}", "STRING") & F.length(_get(json, f"$.{key}", "string")).between(1, most)
    return out & shape.also(json) if shape.also else out


def fits(json: Column, path: Column, shapes: list[Shape] = COMMON) -> Column:
    """Whether parsed JSON has the shape of its path: an empty object fits anywhere, a list at its places only, other values nowhere."""
    p, kind, keys = F.lower(path), F.schema_of_variant(json), keys_of(json)
    out = F.when(kind.startswith("ARRAY"), p.rlike(LIST_PATHS)).when(~kind.startswith("OBJECT"), False).when(F.size(keys) == 0, True)
    for shape in shapes:
        out = out.when(p.rlike(f"(?s)^(?:{shape.path})\\z"), _holds(shape, json, keys))
    return F.coalesce(out.otherwise(False), F.lit(False))
