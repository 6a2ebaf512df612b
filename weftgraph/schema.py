"""Frames of a graph, and the enumerations whose order matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and order of the model's enumerations.
NODE_KINDS = ("CLASS", "INTERFACE", "OBJECT", "ENUM", "ANNOTATION_CLASS", "FUNCTION", "METHOD", "CONSTRUCTOR", "PROPERTY", "FIELD")
TYPE_KINDS = ("CLASS", "INTERFACE", "OBJECT", "ENUM", "ANNOTATION_CLASS")
EDGE_KINDS = ("CALL", "FIELD_ACCESS", "REFERENCE", "INHERITANCE", "OVERRIDE", "MEMBER", "ANNOTATION", "RETENTION")
EDGE_ORIGINS = ("BYTECODE", "KOTLIN_METADATA", "DISPATCH_MODEL", "RUNTIME_MODEL", "COMPILER_REFERENCE", "LIBRARY_CALLBACK_MODEL")
REASONS = (
    "MANIFEST_COMPONENT", "XML_LAYOUT", "KEEP_ANNOTATION", "KEEP_ANNOTATED_MEMBER", "KEEP_ANNOTATED_CLASS_MEMBER", "KEEP_RULE",
    "SHRINKING_DISABLED", "UNKNOWN_KEEP_RULE", "DEPENDENCY_INJECTION", "SERIALIZATION", "GENERATED_CODE", "RUNTIME_ENTRY_POINT",
    "INLINE_CONSTANT", "EXTERNAL_MEMBER_ENTRY", "SERVICE_PROVIDER", "EXTERNAL_BRIDGE",
)
#: Reasons under which a class's own members are entered, too.
OWNER_REASONS = ("SERVICE_PROVIDER", "MANIFEST_COMPONENT", "XML_LAYOUT", "DEPENDENCY_INJECTION", "SERIALIZATION", "GENERATED_CODE", "RUNTIME_ENTRY_POINT")

NODES = (
    "id string, name string, kind string, module string, path string, line int, visibility string, modifiers array<string>, "
    "attributes array<string>, annotations array<string>, supertypes array<string>, synthesized boolean, enum_constants array<string>"
)
EDGES = "source string, target string, kind string, weight int, origin string, lines array<int>"
EXTERNAL_CALLS = "caller string, owner string, name string, descriptor string, kind string, path string, line int, ordinal int, resolved_targets array<string>, resolution string, model string"
ENCLOSURES = "local_class string, enclosing string"
RETENTION = "node_id string, reason string, path string, line int"
SERVICES = "service string, provider string, path string, line int"
DEPENDENCIES = "coordinate string, scope string, artifact string"


def ordinal(kind: Column, names: tuple[str, ...] = EDGE_KINDS) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), kind)


def owner_class(id_: Column) -> Column:
    """``class:`` id of the class that a member belongs to; of a class, itself."""
    return F.concat(F.lit("class:"), F.substring_index(F.regexp_replace(id_, "^[a-z]+:", ""), "#", 1))


def package_of(id_: Column) -> Column:
    """Package of the owner, dotted; ``<default>`` without one."""
    name = F.substring_index(F.regexp_replace(id_, "^[a-z]+:", ""), "#", 1)
    return F.when(F.instr(name, "/") > 0, F.replace(F.regexp_replace(name, "/[^/]*$", ""), F.lit("/"), F.lit("."))).otherwise("<default>")


def unit_of(module: Column, id_: Column) -> Column:
    return F.coalesce(module, package_of(id_))


def qualified_name(id_: Column, name: Column) -> Column:
    """Owner with dots, plus the name for ids of members."""
    owner = F.replace(F.substring_index(F.regexp_replace(id_, "^[a-z]+:", ""), "#", 1), F.lit("/"), F.lit("."))
    return F.when(F.instr(id_, "#") > 0, F.concat_ws(".", owner, name)).otherwise(owner)


def member_signature(id_: Column) -> Column:
    return F.when(F.instr(id_, "#") > 0, F.substring_index(id_, "#", -1))


def is_usage(kind: Column) -> Column:
    return kind != "MEMBER"


def is_dependency(kind: Column, origin: Column) -> Column:
    return is_usage(kind) & (kind != "OVERRIDE") & (origin != "DISPATCH_MODEL")


def is_owner_reference(source: Column, target: Column, kind: Column) -> Column:
    """A member's reference to its own class."""
    return (kind == "REFERENCE") & (F.instr(source, "#") > 0) & (target == owner_class(source))


def is_override_contract(kind: Column, origin: Column) -> Column:
    return (kind == "OVERRIDE") & (origin != "DISPATCH_MODEL")
