"""Column expressions for the symbol grammar: length-prefixed identifiers and the accessor shapes built from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _none() -> Column:
    return F.lit(None).cast("string")


def _let(value: Column, use) -> Column:
    """use(value), with the value's expression evaluated and planned once."""
    return F.get(F.transform(F.array(value), use), 0)


@dataclass
class Identifier:
    """A length-prefixed identifier at the head of a text: its name (null if there is none) and what follows."""

    found: Column

    @property
    def name(self) -> Column:
        return self.found["name"]

    @property
    def rest(self) -> Column:
        return self.found["rest"]


def identifier(text: Column) -> Identifier:
    """Digits, then so many characters; null where digits are missing or the text is too short."""

    def read(t: Column, digits: Column) -> Column:
        n, start = F.try_to_number(digits, F.lit("999999999")).cast("int"), F.char_length(digits) + 1
        fits = (start > 1) & (F.char_length(t) >= start - 1 + n)
        return F.when(fits, F.struct(F.substring(t, start, n).alias("name"), F.substring(t, start + n, F.char_length(t)).alias("rest")))

    return Identifier(_let(text, lambda t: _let(F.regexp_extract(t, "^[0-9]+", 0), lambda digits: read(t, digits))))


def after(text: Column, prefix: str) -> Column:
    """What follows the prefix, or null."""
    return F.when(text.startswith(prefix), F.substring(text, F.lit(len(prefix) + 1), F.char_length(text))).otherwise(_none())


def _ends(text: Column, *suffixes: str) -> Column:
    found = text.endswith(suffixes[0])
    for s in suffixes[1:]:
        found = found | text.endswith(s)
    return found


def imported_struct_container(usr: Column) -> Column:
    """the imported struct whose member's accessor this is."""
    kind = identifier(after(usr, "s:So"))
    member = identifier(after(kind.rest, "V"))
    ok = member.name.isNotNull() & ~member.rest.startswith("E") & _ends(usr, "vg", "vs", "vgZ", "vsZ")
    return F.when(ok, F.concat(F.lit("s:So"), F.char_length(kind.name).cast("string"), kind.name, F.lit("V"))).otherwise(_none())


def is_imported_constant(usr: Column) -> Column:
    """an accessor of a top-level imported constant."""
    name = identifier(F.coalesce(after(usr, "s:So"), after(usr, "s:SC")))
    head = F.substring(name.rest, 1, 1)
    ok = name.name.isNotNull() & (F.char_length(name.rest) > 0) & ~head.isin("V", "C", "O", "a", "P") & _ends(name.rest, "vg", "vs")
    return F.coalesce(ok, F.lit(False))


#: Marker and suffix of the accessors that enums get of themselves.
ENUM_ACCESSORS = (("O8rawValue", "vg"), ("O8allCases", "vgZ"))


def swift_enum(usr: Column) -> Column:
    """the enum whose synthesized accessor this is, up to and with its O."""
    found = _none()
    for marker, suffix in reversed(ENUM_ACCESSORS):
        at = F.instr(usr, marker)
        found = F.when(usr.startswith("s:") & (at > 0) & usr.endswith(suffix), F.substring(usr, F.lit(1), at)).otherwise(found)
    return found


def objc_enum(usr: Column) -> Column:
    """F8: the same for an enum of the other language."""
    module = identifier(after(usr, "s:"))
    kind = identifier(module.rest)
    ok = F.lit(False)
    for marker, suffix in ENUM_ACCESSORS:
        ok = ok | (kind.rest.startswith(marker) & kind.rest.endswith(suffix))
    return F.when(ok, F.concat(F.lit("c:@M@"), module.name, F.lit("@E@"), kind.name)).otherwise(_none())


HASH_VALUE = "9hashValueSivg"


def hashable_owner(usr: Column) -> Column:
    """the type whose hash accessor this is."""
    ok = usr.startswith("s:") & usr.endswith(HASH_VALUE) & (F.char_length(usr) > len(HASH_VALUE) + 2)
    return F.when(ok, F.substring(usr, F.lit(1), F.char_length(usr) - len(HASH_VALUE))).otherwise(_none())


def subscript_declaration(usr: Column) -> Column:
    """the subscript of an accessor."""
    return F.when(_ends(usr, "cig", "cis"), F.regexp_replace(usr, "ci[gs]$", "cip")).otherwise(_none())


def module_of(usr: Column) -> Column:
    """the module's name, null without a suffix after it."""
    module = identifier(after(usr, "s:"))
    return F.when(F.char_length(module.rest) > 0, module.name).otherwise(_none())


def module_suffix(usr: Column) -> Column:
    """what follows the module's name, null if nothing does."""
    module = identifier(after(usr, "s:"))
    return F.when(F.char_length(module.rest) > 0, module.rest).otherwise(_none())


def static_declaration(usr: Column) -> Column:
    """the static member of an accessor."""
    ok = module_of(usr).isNotNull() & _ends(usr, "vgZ", "vsZ")
    return F.when(ok, F.regexp_replace(usr, "v[gs]Z$", "vpZ")).otherwise(_none())


def objc_property(usr: Column) -> Column:
    """the property of an imported class whose accessor this is."""
    kind = identifier(after(usr, "s:So"))
    member = identifier(after(kind.rest, "C"))
    ok = member.name.isNotNull() & (F.char_length(member.name) > 0) & _ends(usr, "vg", "vs")
    return F.when(ok, F.concat(F.lit("c:objc(cs)"), kind.name, F.lit("(py)"), member.name)).otherwise(_none())


def same_symbol(found: Column, wanted: Column) -> Column:
    """equal, or equal up to a synthesized tail."""
    tail = "::SYNTHESIZED::"
    return (found == wanted) | (F.substring_index(found, tail, 1) == wanted) | (found == F.substring_index(wanted, tail, 1))


def without_module_qualifier(usr: Column) -> Column:
    """the symbol without a c:@CM@module@@ qualifier."""
    return F.regexp_replace(usr, "^c:@CM@[^@]*@@", "c:")


def demangled_signature(text: Column) -> Column:
    """the signature without its module, private discriminators collapsed to the name."""
    rest = F.when(F.instr(text, ".") > 0, F.substring(text, F.instr(text, ".") + 1, F.char_length(text))).otherwise(text)
    return F.regexp_replace(rest, r"\(([^()\s]+) in _[0-9A-F]+\)", "$1")


def is_demangled_struct_member(text: Column) -> Column:
    """a getter or setter of an imported struct."""
    return text.startswith("__C.") & (text.contains(".getter : ") | text.contains(".setter : "))


@dataclass(frozen=True)
class Bridged:
    """A shape F15-F20: what the accessor parses to and what a candidate symbol must be."""

    name: str
    marker: str
    named: bool
    container_end: str
    candidate_prefix: str


#: The bridged shapes in order of preference.
BRIDGED = (
    Bridged("extern_constant", "a", True, "amD", "c:@"),
    Bridged("extern_constant_container", "a", False, "amD", "c:@"),
    Bridged("extern_constant_optional", "a", False, "amD", "c:@"),
    Bridged("extern_class_constant", "C", True, "CmD", "c:@"),
    Bridged("protocol_property_witness", "", False, "CD", "c:objc(pl)"),
    Bridged("extern_function_property", "a", False, "aD", "c:@F@"),
)


def bridged_target(usr: Column, shape: Bridged) -> tuple[Column, Column]:
    """(type name, member name) of an accessor in a bridged shape; the type is null if it has another shape."""
    if shape.name == "protocol_property_witness":
        rest = after(usr, "c:objc(cs)")
        ok = rest.rlike(r"^[^(]+\(im\).+")
        return F.when(ok, F.substring_index(rest, "(", 1)).otherwise(_none()), _none()
    kind = identifier(after(usr, "s:So"))
    rest = after(kind.rest, shape.marker)
    member = identifier(rest)
    if shape.name == "extern_constant":
        other = identifier(after(member.rest, "E"))
        name = F.when(member.rest == "ABvgZ", member.name).when(other.rest == "ABvgZ", other.name).otherwise(_none())
        return F.when(name.isNotNull(), kind.name).otherwise(_none()), name
    if shape.name == "extern_class_constant":
        ok = (F.char_length(member.name) > 0) & rest.endswith("vgZ")
        return F.when(ok, kind.name).otherwise(_none()), F.when(ok, member.name).otherwise(_none())
    if shape.name == "extern_function_property":
        ok = (F.char_length(member.name) > 0) & rest.endswith("vg")
        return F.when(ok, kind.name).otherwise(_none()), _none()
    ending = "ABvgZ" if shape.name == "extern_constant_container" else "ABSgvgZ"
    return F.when(rest.endswith(ending), kind.name).otherwise(_none()), _none()


def bridged_match(target: Column, usr: Column, name: Column, lang: Column, container: Column, shape: Bridged) -> Column:
    """Whether a candidate symbol is what the accessor stands for."""
    kind, member = bridged_target(target, shape)
    wanted = F.concat(F.lit("$sSo"), F.octet_length(kind).cast("string"), kind, F.lit(shape.container_end))
    ok = (lang == "source.lang.objc") & usr.startswith(shape.candidate_prefix) & (container == wanted)
    if shape.named:
        ok = ok & (name == member)
    if shape.name == "protocol_property_witness":
        ok = ok & usr.contains("(py)")
    return F.coalesce(ok, F.lit(False))
