"""Rules for facts about Java programs, as patterns over the fact store.

Families that differ in one relation are made from one template: what an unmapped type holds in a
file that is gone (pruned) or new (grafted), and constructor calls without arguments.
"""

from __future__ import annotations

from collections.abc import Callable

from .pattern import Bindings
from .rules import Rule

B = Bindings
RULES: dict[str, Rule] = {}


def rule(name: str, *templates: str) -> Callable:
    def add(body: Callable[[B], B]) -> Callable[[B], B]:
        RULES[name] = Rule(name, templates, body)
        return body

    return add


# --- where things are -------------------------------------------------------------------------------


@rule("tdecl_in_srctree", "?t inSourceTree ?tree", "?t version ?v")
def _(b: B) -> B:
    return b.match("?t a TypeDeclaration", "?t inFile ?f", "?f a File", "?f inSourceTree ?tree", "?tree a SourceTree", "?tree version ?v")


def _mapped_flags(b: B, var: str) -> B:
    return b.flag("from_", f"?{var} mappedTo ?any1").flag("to_", f"?any2 mappedTo ?{var}").where("from_ or to_")


@rule("stmt_level0", "?x stmtLevel 0")
def _(b: B) -> B:
    b = b.match("?x a Statement", "?x inTypeDeclaration/inFile/location ?loc", "?x parent ?p", "?p a! ?kind")
    return _mapped_flags(b.values("kind", ["MethodBody", "ConstructorBody", "StaticInitializer"]), "x")


def _levels(b: B) -> B:
    """Depth below a top-level statement: steps of the shortest chain of enclosing statements."""
    return _mapped_flags(b.match("?x a Statement").steps("?x inStatement ?top", "n").match("?top a Statement", "?top stmtLevel 0"), "x")


rule("stmt_level", "?x stmtLevel ?n")(_levels)


# --- what is gone and what is new -------------------------------------------------------------------

_HELD = {  # for what: patterns from the unmapped type ?t to the thing ?x
    "tdecl": ([], "t"),
    "method": (["?x a MethodOrConstructor", "?x inTypeDeclaration ?t"], "x"),
    "name": (["?x a Name", "?x inTypeDeclaration ?t"], "x"),
    "invocation": (["?x a InvocationOrInstanceCreation", "?x inTypeDeclaration ?t"], "x"),
    "field_access": (["?x a FieldAccess", "?x inTypeDeclaration ?t"], "x"),
    "field": (["?d a FieldDeclaration", "?d inTypeDeclaration ?t", "?x parent* ?d"], "x"),
}


def _tree_change(kind: str) -> None:
    prop, mapped = ("prunedFrom", "?{} mappedTo ?any") if kind == "pruned" else ("graftedOnto", "?any mappedTo ?{}")
    head = ["?tree a SourceTree", "?tree version ?v", "?f inSourceTree ?tree", "?f a File", f"?f {prop} ?other"]
    typed = [*head, "?t inFile ?f", "?t a TypeDeclaration"]

    for what, (more, out) in _HELD.items():
        rule(f"{kind}_{what}", f"?{out} {prop} ?other")(lambda b, more=more: b.match(*typed, *more).unless(mapped.format("t")))

    @rule(f"{kind}_import", f"?x {prop} ?other")
    def _(b: B) -> B:
        return b.match(*head, "?x parent/parent/inFile ?f", "?x a ImportDeclaration").unless(mapped.format("x"))

    @rule(f"{kind}_param", f"?x {prop} ?other", f"?ty {prop} ?other")
    def _(b: B) -> B:
        return b.match(*typed, "?x inTypeDeclaration ?t", "?x a Parameter", "?ty parent ?x", "?ty a ReferenceType").unless(mapped.format("t"))

    @rule(f"{kind}_super_type", f"?ty {prop} ?other")
    def _(b: B) -> B:
        b = b.match(*typed, "?x parent/parent ?t", "?x a ?kind").values("kind", ["Extends", "ExtendsInterfaces", "Implements"])
        return b.match("?ty parent ?x", "?ty a ReferenceType").unless(mapped.format("t"))

    # For pruned constants it is the enum that is written, for grafted ones the constant.
    @rule(f"{kind}_enum_const", f"?{'t' if kind == 'pruned' else 'x'} {prop} ?other")
    def _(b: B) -> B:
        return b.match(*head, "?t inFile ?f", "?t a EnumDeclaration", "?x inEnum ?t", "?x a EnumConstant").unless(mapped.format("t"))


_tree_change("pruned")
_tree_change("grafted")


# --- what corresponds -------------------------------------------------------------------------------


@rule("stable_mapping", "?x mappedStablyTo ?y")
def _(b: B) -> B:
    b = b.match("?x mappedTo ?y", "?x a Entity", "?y a Entity").distinct("x", "y")
    return b.unless("?x movedTo ?y").unless("?x mappedStablyTo ?y")


def _same_type(b: B) -> B:
    b = b.match("?f correspondsTo ?g", "?f a File", "?f inSourceTree ?tree", "?g a File", "?g inSourceTree ?tree2", "?x inFile ?f", "?x a TypeDeclaration", "?x a! ?kind", "?x fullyQualifiedName ?name")
    return b.match("?y inFile ?g", "?y fullyQualifiedName ?name", "?y a TypeDeclaration", "?y a! ?kind")


@rule("tdecl_mapped_eq", "?x mappedEqTo ?y")
def _(b: B) -> B:
    return _same_type(b).distinct("x", "y")


@rule("tdecl_modified", "?x modified ?y")
def _(b: B) -> B:
    return _same_type(b).match("?x treeDigest ?d", "?y treeDigest ?e").where("d <> e").distinct("x", "y")


@rule("file_mapping", "?f ?how ?g")
def _(b: B) -> B:
    b = b.match("?t mappedTo ?u", "?t a TypeDeclaration", "?u a TypeDeclaration", "?t inFile ?f", "?u inFile ?g", "?f version ?v", "?v next ?w", "?g version ?w")
    b = b.match("?f fileDigest ?d", "?g fileDigest ?e", "?f location ?l", "?g location ?m").unless("?f mappedTo ?g")
    return b.bind("how", "CASE WHEN d = e THEN 'mappedEqTo' ELSE 'mappedNeqTo' END")


# --- hierarchies ------------------------------------------------------------------------------------


def _named_or_raw(b: B, var: str) -> B:
    """Candidates for a type's name: as it is, and without its type arguments (none without '<')."""
    return b.each("key", [var, f"CASE WHEN instr({var}, '<') > 0 THEN substr({var}, 1, instr({var}, '<') - 1) END"])


@rule("class_hierarchy", "?x subClassOf ?y")
def _(b: B) -> B:
    b = b.match("?x a TypeDeclaration", "?x fullyQualifiedName ?own", "?x version ?v", "?e inTypeDeclaration ?x", "?e a! ?kind").values("kind", ["Extends", "ExtendsInterfaces", "Implements"])
    b = b.match("?ty parent ?e", "?ty a ReferenceType", "?ty name ?n")
    return _named_or_raw(b, "n").distinct("x", "v", "key").match("?y fullyQualifiedName ?key", "?y version ?v", "?y a TypeDeclaration", "?y inFile ?f")


@rule("interface_hierarchy", "?x subInterfaceOf ?y")
def _(b: B) -> B:
    b = b.match("?x a InterfaceDeclaration", "?x fullyQualifiedName ?own", "?x version ?v", "?e inTypeDeclaration ?x", "?e a ExtendsInterfaces", "?ty parent ?e", "?ty a ReferenceType", "?ty name ?n")
    return _named_or_raw(b, "n").distinct("x", "v", "key").match("?y fullyQualifiedName ?key", "?y version ?v", "?y a TypeDeclaration", "?y inFile ?f")


@rule("class_name_hierarchy", "?n subClassNameOf ?m")
def _(b: B) -> B:
    b = b.match("?x a TypeDeclaration", "?x fullyQualifiedName ?n", "?e inTypeDeclaration ?x", "?e a ?kind").values("kind", ["Extends", "ExtendsInterfaces", "Implements"])
    return b.match("?ty parent ?e", "?ty a ReferenceType", "?ty name ?m")


@rule("refers_to_decl", "?x refersToDeclaration ?t")
def _(b: B) -> B:
    b = b.match("?x a ReferenceType", "?x unqualifiedName ?u", "?x name ?n", "?x inTypeDeclaration/version ?v").bind("n", "translate(n, '$', '.')")
    b = _named_or_raw(b, "n").distinct("x", "u", "v", "key")
    return b.match("?t name ?u", "?t version ?v", "?t a TypeDeclaration", "?t fullyQualifiedName ?q").where("translate(q, '$', '.') = key")


# --- types of declarations --------------------------------------------------------------------------


def _type_name(b: B, ty: str = "ty") -> B:
    """The name of a type node: the label of its class, or its own name."""
    return b.either([f"?{ty} a! ?cat", "?cat label ?name_"], f"?{ty} name ?name_")


@rule("return_type", "?m returnTypeName ?name_", "?m returnTypeDims ?dims")
def _(b: B) -> B:
    return _type_name(b.match("?m a MethodDeclaration", "?m child2 ?ty", "?ty a Type", "?ty parent ?d")).optional("?ty dimensions ?dims")


@rule("return_reftype", "?m returnType ?t")
def _(b: B) -> B:
    return b.match("?m a MethodDeclaration", "?m child2 ?ty", "?ty a ReferenceType", "?ty refersToDeclaration ?t")


@rule("param_ty_name", "?p typeName ?name_", "?p typeDims ?dims")
def _(b: B) -> B:
    b = b.match("?p a Parameter", "?p name ?pname", "?p child1 ?ty").distinct("p", "ty").match("?ty a Type", "?ty parent ?p")
    return _type_name(b).optional("?ty dimensions ?dims")


@rule("param_ty", "?m ?named ?name_", "?m ?sized ?dims")
def _(b: B) -> B:
    """The position of a parameter becomes part of the predicate's name, 0 to 15."""
    b = b.match("?m a MethodOrConstructor", "?m child2|child3 ?ps", "?ps a Parameters").numbered("?ps child ?p", "n", range(16)).match("?p a Parameter", "?p child1 ?ty")
    b = b.either("?ty name ?name_", ["?ty a PrimitiveType", "?ty a! ?cat", "?cat label ?name_"]).optional("?p dimensions ?d0").optional("?ty dimensions ?d1")
    b = b.bind("dims", "coalesce(cast(d0 as int), 0) + coalesce(cast(d1 as int), 0)")
    return b.bind("named", "concat('parameterTypeName', n)").bind("sized", "concat('parameterTypeDims', n)")


# --- what a name is declared by ---------------------------------------------------------------------


def _scoped(header: str, declared: str, holder: str, child: str, body: str) -> Callable[[B], B]:
    def solve(b: B) -> B:
        b = b.match(f"?h a {holder}", f"?h {child} ?d", f"?h {body} ?body", f"?d a {declared}", "?d name ?n")
        return b.match("?x parent+ ?body", "?x name ?n", "?x a Name").unless("?x declaredBy ?any")

    return solve


rule("declared_by_catch_param", "?x declaredBy ?d")(_scoped("catch", "CatchParameter", "CatchClause", "child0", "child1"))
rule("declared_by_for_header", "?x declaredBy ?d")(_scoped("for", "ForHeader", "EnhancedForStatement", "child0", "child2"))


def _own_access(b: B, *more: str) -> B:
    """Field accesses without a qualifier, or on ``this``."""
    b = b.match("?x a FieldAccess", "?x name ?n", *more)
    return b.flag("on_this", "?x child0 ?q", "?q a This").flag("qualified", "?x child0 ?q2").where("on_this or not qualified")


_FIELD = ["?fd a FieldDeclaration", "?fd child2 ?d", "?d a VariableDeclarator", "?d parent ?fd", "?d name ?n"]


@rule("declared_by_field0-0-0", "?x declaredBy ?d")
def _(b: B) -> B:
    return _own_access(b, "?x inInstanceCreation ?new").distinct("x", "n", "new").match("?fd inInstanceCreation ?new", *_FIELD).unless("?x declaredBy ?any")


@rule("declared_by_field0-0-1", "?x declaredBy ?d")
def _(b: B) -> B:
    return _own_access(b, "?x inTypeDeclaration ?t").distinct("x", "n", "t").match("?fd inTypeDeclaration ?t", *_FIELD).unless("?x declaredBy ?any")


@rule("declared_by_field0-0-2", "?x declaredBy ?d")
def _(b: B) -> B:
    b = _own_access(b, "?x inInstanceCreation ?new").distinct("x", "n", "new").match("?new ofReferenceType ?t", "?t version ?v", "?t subTypeOf* ?t0", "?t0 version ?v")
    return b.match("?fd inTypeDeclaration ?t0", *_FIELD).unless("?x declaredBy ?any")


@rule("declared_by_field1", "?x declaredBy ?d")
def _(b: B) -> B:
    b = b.match("?x a FieldAccess", "?x name ?n", "?x child0 ?e", "?e a Expression", "?e ofReferenceType ?t0").distinct("x", "n", "t0")
    b = b.match("?t0 (inTypeDeclaration~subTypeOf)* ?t", "?t version ?v", "?t0 version ?v")
    return b.match("?fd inTypeDeclaration ?t", "?fd child1 ?ty", *_FIELD).unless("?x declaredBy ?any")


# --- names that are resolved ------------------------------------------------------------------------


def _ambiguous(b: B) -> B:
    return b.unless("?x a! FieldAccess").unless("?x a! Name")


@rule("resolved_facc", "?x a FieldAccess", "?x name ?id")
def _(b: B) -> B:
    return _ambiguous(b.match("?x a AmbiguousName", "?x name ?n", "?x identifier ?id", "?x child0 ?x0", "?x0 a FieldAccess"))


@rule("resolved_facc0", "?x a FieldAccess")
def _(b: B) -> B:
    b = b.match("?x a AmbiguousName", "?x name ?n", "?x inTypeDeclaration ?t", "?t version ?v", "?t fullyQualifiedName ?q", "?t subTypeOf+ ?t0", "?t0 version ?v")
    b = b.match("?fd inTypeDeclaration ?t0", "?fd a FieldDeclaration", "?d inField ?fd", "?d a VariableDeclarator", "?d name ?n")
    return _ambiguous(b.unless("?x identifier ?i", "?x qualifier ?j"))


@rule("resolved_enum_const", "?x name ?whole")
def _(b: B) -> B:
    b = b.match("?c a EnumConstant", "?c name ?cn", "?c inEnum ?en", "?en a EnumDeclaration", "?en name ?enn", "?en fullyQualifiedName ?q", "?en inTypeDeclaration ?t", "?t version ?v")
    b = b.bind("whole", "concat(q, '.', cn)").bind("n", "concat(enn, '.', cn)").distinct("v", "t", "whole", "n")
    return b.match("?u subTypeOf* ?t", "?u version ?v", "?x inTypeDeclaration ?u", "?x name ?n")


@rule("resolved_reftype", "?x name ?whole")
def _(b: B) -> B:
    b = b.match("?t a TypeDeclaration", "?t inFile ?f", "?t inSourceTree ?tree", "?t name ?u", "?t fullyQualifiedName ?q", "?p a PackageDeclaration", "?p parent/inFile ?f", "?p name ?pn")
    b = b.bind("whole", "translate(q, '$', '.')").distinct("tree", "u", "whole", "pn")
    b = b.match("?x unqualifiedName ?u", "?x a ReferenceType", "?x name ?n").where("n <> whole and whole = concat(pn, '.', n)")
    return b.match("?x inTypeDeclaration/inFile ?g", "?g inSourceTree ?tree", "?r parent/inFile ?g", "?r a PackageDeclaration", "?r name ?pn")


@rule("resolved_tyvar", "?x name ?bound")
def _(b: B) -> B:
    b = b.match("?t a TypeDeclaration", "?t fullyQualifiedName ?q", "?t child0/child1 ?ps", "?ps a TypeParameters").distinct("t", "ps")
    b = b.match("?p parent ?ps", "?p a TypeParameter", "?p name ?n", "?p child1 ?tb", "?tb a TypeBound", "?tb child0 ?bt", "?bt name ?bound")
    return b.match("?x inTypeDeclaration ?t", "?x a ReferenceType", "?x name ?n")


def _retyped(kind: str) -> Callable[[B], B]:
    def solve(b: B) -> B:
        b = b.match("?m a MethodDeclaration", "?m name ?n", "?m inTypeDeclaration ?t", "?t a TypeDeclaration", "?t name ?tn", "?t fullyQualifiedName ?q").distinct("n", "tn", "q")
        return b.match("?x name ?n", f"?x a {kind}", "?x child0/name ?tn").bind("whole", "concat(q, '.', n)")

    return solve


rule("resolved_type_ivk_pe", "?x a TypeMethodInvocation", "?x name ?whole")(_retyped("PrimaryMethodInvocation"))
rule("resolved_type_ivk_ps", "?x a TypeMethodInvocationStatement", "?x name ?whole")(_retyped("PrimaryMethodInvocationStatement"))


# --- declarations of the types of expressions -------------------------------------------------------

_TREE = "?x inTypeDeclaration/inSourceTree ?tree"
_DECLARED = ["?t fullyQualifiedName ?tn", "?t inSourceTree ?tree", "?t a TypeDeclaration"]


def _untyped(b: B) -> B:
    return b.unless("?x ofReferenceType ?any")


@rule("reftype_of_cast", "?x ofReferenceType ?t")
def _(b: B) -> B:
    return b.match("?x a Cast", _TREE, "?x child0 ?ty", "?ty a ReferenceType", "?ty name ?tn", *_DECLARED)


@rule("reftype_of_expr0", "?x ofReferenceType ?t")
def _(b: B) -> B:
    return _untyped(b.match("?x a ArrayAccess").either("?x child0/ofReferenceType ?t", ["?x typeName ?tn", _TREE, *_DECLARED]))


@rule("reftype_of_expr1", "?x ofReferenceType ?t")
def _(b: B) -> B:
    return _untyped(b.match("?x a ParenthesizedExpression", "?x child0/ofReferenceType ?t"))


@rule("reftype_of_expr2", "?x ofReferenceType ?t")
def _(b: B) -> B:
    b = b.match(*_FIELD, "?fd inTypeDeclaration ?t0", "?t0 inSourceTree ?tree", "?fd child1 ?ty", "?ty a ReferenceType", "?ty parent ?fd", "?ty name ?tn").distinct("t0", "n", "tn", "tree")
    b = b.match("?u subTypeOf* ?t0", "?u a TypeDeclaration", "?u inSourceTree ?tree", *_DECLARED).distinct("u", "n", "t", "tree")
    return _untyped(b.match("?e ofReferenceType ?u", "?e a Expression", "?x child0 ?e", "?x name ?n", "?x a FieldAccess", _TREE))


@rule("reftype_of_array_access", "?x ofReferenceType ?t")
def _(b: B) -> B:
    return _untyped(b.match("?x a ArrayAccess", "?x child0+ ?y", "?y ofReferenceType ?t"))


@rule("reftype_of_new", "?x ofReferenceType ?t")
def _(b: B) -> B:
    return _untyped(b.match("?x a InstanceCreation", "?x mayInvokeMethod ?m", "?m a ConstructorDeclaration", "?m inClass ?t"))


@rule("reftype_of_new0", "?x ofReferenceType ?t")
def _(b: B) -> B:
    b = b.match("?t a TypeDeclaration", "?t inSourceTree ?tree", "?t fullyQualifiedName ?q").bind("n", "concat(q, '.<init>')").distinct("t", "tree", "n")
    return _untyped(b.match("?x name ?n", "?x a InstanceCreation", _TREE))


@rule("reftype_of_enum_const", "?x ofReferenceType ?en")
def _(b: B) -> B:
    return _untyped(_enum_constant(b))


def _enum_constant(b: B) -> B:
    b = b.match("?en a EnumDeclaration", "?en fullyQualifiedName ?q", "?en inSourceTree ?tree", "?c inEnum ?en", "?c a EnumConstant", "?c name ?cn").bind("whole", "concat(q, '.', cn)")
    return b.match("?x name ?whole", "?x a Name", _TREE)


def _of_this(b: B, prop: str) -> B:
    """What ``this`` is: the enclosing type, or inside an anonymous creation what that creates."""
    ways = b.match("?x a This")
    own = ways.match("?x inTypeDeclaration ?u").unless("?x inStatement/inInstanceCreation ?any")
    own = own.bind("t", "u") if prop == "ofReferenceType" else own.match("?u fullyQualifiedName ?t")
    made = ways.match("?x inStatement/inInstanceCreation ?new", f"?new {prop} ?t")
    return own.distinct("x", "t").plus(made.distinct("x", "t")).unless(f"?x {prop} ?any")


rule("reftype_of_this", "?x ofReferenceType ?t")(lambda b: _of_this(b, "ofReferenceType"))
rule("type_of_this", "?x typeName ?t")(lambda b: _of_this(b, "typeName"))


@rule("reftype_of_declared_var", "?x ofReferenceType ?t", "?x typeName ?tn")
def _(b: B) -> B:
    b = b.match("?x a Name", "?x name ?n", "?x declaredBy ?d", _TREE, "?x inTypeDeclaration ?c", "?c a TypeDeclaration").distinct("x", "d")
    b = b.either(["?d a VariableDeclarator", "?d inVariableDeclaration ?vd", "?ty parent ?vd"], ["?d a Resource", "?d child1 ?ty"])
    return b.match("?ty a ReferenceType", "?ty refersToDeclaration ?t", "?ty name ?tn")


def _by_param(b: B) -> B:
    b = b.match("?x a Name", "?x name ?n", "?x inMethodOrConstructor ?m", "?x declaredBy ?p", "?p a Parameter", "?p name ?pn", "?m a MethodOrConstructor", "?m inTypeDeclaration ?c", "?c a TypeDeclaration")
    return b


@rule("reftype_of_var_declared_by_param", "?x ofReferenceType ?t")
def _(b: B) -> B:
    b = _by_param(b).match("?c inSourceTree ?tree").distinct("x", "p", "tree")
    return b.match("?ty parent ?p", "?ty a ReferenceType", "?ty name ?tn", *_DECLARED)


@rule("reftype_of_ivk", "?x ofReferenceType ?t")
def _(b: B) -> B:
    return b.match("?m a MethodDeclaration", "?m fullyQualifiedName ?q", "?m signature ?sig", "?m inTypeDeclaration/inSourceTree ?tree", "?m returnType ?t", "?x mayInvokeMethod ?m", "?x a Invocation")


# --- names of the types of expressions --------------------------------------------------------------

_LITERALS = {  # fixed values
    "IntegerLiteral": "int", "CharacterLiteral": "char", "StringLiteral": "java.lang.String", "True": "boolean",
    "False": "boolean", "ClassLiteral": "java.lang.Class", "ClassLiteralVoid": "java.lang.Class",
}
_PRIMITIVES = ["boolean", "double", "float", "byte", "char", "int", "long", "short"]


def _nameless(b: B) -> B:
    return b.unless("?x typeName ?any")


rule("type_of_literal", "?x typeName ?tn")(lambda b: b.classes("x", _LITERALS, "tn"))


@rule("type_of_declared_var", "?x typeName ?tn", "?x typeDims ?dims")
def _(b: B) -> B:
    b = b.match("?x a Name", "?x declaredBy ?d", "?d a VariableDeclarator", "?d inVariableDeclaration ?vd", "?ty parent ?vd", "?ty a Type")
    named = b.fresh().classes("ty", {f"{p.capitalize()}Type": p for p in _PRIMITIVES}, "tn").plus(b.fresh().match("?ty name ?tn"))
    return b.join(named).optional("?ty dimensions ?dims")


@rule("type_of_var_declared_by_param", "?x typeName ?name_", "?x typeDims ?dims")
def _(b: B) -> B:
    return _type_name(_by_param(b).distinct("x", "p").match("?ty parent ?p", "?ty a Type")).optional("?ty dimensions ?dims")


@rule("type_of_new", "?x typeName ?tn")
def _(b: B) -> B:
    return b.match("?x a StandardInstanceCreation", "?x child1/name ?tn")


@rule("type_of_enum_const", "?x typeName ?whole")
def _(b: B) -> B:
    return _nameless(_enum_constant(b))


@rule("type_of_uop", "?x typeName ?tn")
def _(b: B) -> B:
    return _nameless(b.match("?x a UnaryOp", "?x child0/typeName ?tn"))


@rule("type_of_bop", "?x typeName ?tn", "?x typeDims ?dims")
def _(b: B) -> B:
    """Both operands count, so that an operation may get two names."""
    b = b.match("?x a BinaryOp", "?x child0 ?l", "?x child1 ?r").each("e", ["l", "r"])
    return _nameless(b.match("?e typeName ?tn").optional("?e typeDims ?dims"))


@rule("type_of_cast", "?x typeName ?tn", "?x typeDims ?dims")
def _(b: B) -> B:
    """Its template's subject is never bound, so it gives no facts."""
    b = b.match("?c a Cast", "?c child0 ?ty", "?ty name ?tn").optional("?ty dimensions ?dims")
    return b.bind("x", "cast(null as string)")


@rule("type_of_array_access", "?x typeName ?tn", "?x typeDims ?less")
def _(b: B) -> B:
    b = b.match("?x a ArrayAccess", "?x child0+ ?y", "?y typeName ?an").optional("?y typeDims ?dims")
    return b.bind("tn", "substr(an, 1, greatest(length(an) - 2, 0))").bind("less", "cast(dims as int) - 1")


@rule("type_of_ivk", "?x typeName ?tn", "?x typeDims ?dims")
def _(b: B) -> B:
    return b.match("?m a MethodDeclaration", "?m fullyQualifiedName ?q", "?m signature ?sig", "?m returnTypeName ?tn", "?x mayInvokeMethod ?m", "?x a Invocation").optional("?m returnTypeDims ?dims")


# --- calls without arguments ------------------------------------------------------------------------


def _constructor_call(kind: str, of_super: bool) -> Callable[[B], B]:
    def solve(b: B) -> B:
        b = b.match("?t a TypeDeclaration", "?t inFile/location ?loc", "?own inTypeDeclaration ?t", "?own a ConstructorDeclaration", "?x inConstructor ?own", f"?x a {kind}", "?x child1 ?args")
        b = b.unless("?arg parent ?args")
        b = b.match("?t subClassOf ?target") if of_super else b.bind("target", "t")
        b = b.match("?m inTypeDeclaration ?target", "?m a ConstructorDeclaration", "?m nParameters 0", "?m fullyQualifiedName ?q", "?m signature ?sig")
        return b.bind("called", "concat(q, sig)").unless("?x mayInvoke ?any1", "?x mayInvokeMethod ?any2")

    return solve


rule("super_ivk0", "?x mayInvoke ?called", "?x mayInvokeMethod ?m")(_constructor_call("SuperInvocation", True))
rule("this_ivk0", "?x mayInvoke ?called", "?x mayInvokeMethod ?m")(_constructor_call("ThisInvocation", False))


# --- overloads --------------------------------------------------------------------------------------


def _applicable(b: B) -> B:
    """Of candidates (x, args, m, nparams, nargs, v): those whose arity fits and none of whose arguments contradicts its parameter.

    An argument contradicts a parameter's type name if it has no such type name, and is of no type
    declared by that name or below it in the version, and the name isn't java.lang.Object; or if both
    have dimensions and these differ.  Beyond the parameters of a method of variable arity, arguments
    are held against its last one.  Only arguments 0 to 5 are looked at; unknown ones contradict nothing.
    """
    b = b.bind("nparams", "cast(nparams as int)").bind("nargs", "cast(nargs as int)").where("nparams between 1 and 15").flag("many", "?m isVariableArityMethod true")
    b = b.where("nparams = nargs or (many and (nargs = nparams - 1 or nparams < nargs))")
    d = b.distinct("x", "m", "args", "nparams", "nargs", "v").numbered("?args child ?arg", "place", range(6))
    d = d.bind("k", "CASE WHEN place < nparams THEN place WHEN place < nargs THEN nparams - 1 END")
    d = d.join(b.fresh().numbered("?m parameterTypeName ?named", "k", range(16))).join(b.fresh().numbered("?m parameterTypeDims ?pdims", "k", range(16)), "left")
    same = b.fresh().match("?arg typeName ?named").distinct("arg", "named").bind("same", "true")
    below = b.fresh().match("?arg ofReferenceType ?aty", "?aty version ?v", "?aty subTypeOf* ?ty", "?ty version ?v", "?ty a TypeDeclaration", "?ty fullyQualifiedName ?named")
    d = d.join(same, "left").join(below.distinct("arg", "named", "v").bind("below", "true"), "left").optional("?arg typeDims ?adims")
    wrong = d.where("(same is null and below is null and named <> 'java.lang.Object') or adims <> pdims").distinct("x", "m")
    return b.join(wrong, "left_anti")


def _uncalled(b: B) -> B:
    return b.unless("?x mayInvoke ?any1", "?x mayInvokeMethod ?any2")


def _method(b: B, kind: str) -> B:
    return b.match(f"?m a {kind}", "?m fullyQualifiedName ?q", "?m signature ?sig").bind("called", "concat(q, sig)")


_CALL = ("?x mayInvoke ?called", "?x mayInvokeMethod ?m")


@rule("this_ivkx", *_CALL)
def _(b: B) -> B:
    b = b.match("?x a ThisInvocation", "?x inConstructor ?own", "?x nArguments ?nargs", "?x child1 ?args", "?own a ConstructorDeclaration", "?own inTypeDeclaration ?t", "?t a TypeDeclaration", "?t version ?v")
    return _uncalled(_applicable(_method(b.match("?m inTypeDeclaration ?t", "?m nParameters ?nparams"), "ConstructorDeclaration")))


@rule("super_ivkx", *_CALL)
def _(b: B) -> B:
    b = b.match("?x a SuperInvocation", "?x inConstructor ?own", "?x nArguments ?nargs", "?x child1 ?args", "?own a ConstructorDeclaration", "?own inTypeDeclaration ?t", "?t a TypeDeclaration", "?t version ?v", "?t subClassOf ?u")
    return _uncalled(_applicable(_method(b.match("?m inTypeDeclaration ?u", "?m nParameters ?nparams"), "ConstructorDeclaration")))


def _in_reach(b: B, of: str = "t", to: str = "u") -> B:
    """Types that a type sees without a qualifier: of the types around it and itself, their super types and themselves."""
    return b.match(f"?{of} inTypeDeclaration* ?around", f"?around subTypeOf* ?{to}", f"?{of} version ?v", f"?{to} version ?v")


def _simple(b: B, name: str) -> B:
    b = b.match("?x a Invocation", "?x a! ?kind", "?x inTypeDeclaration ?t", f"?x {name} ?n", "?x child1 ?args").values("kind", ["SimpleMethodInvocation", "SimpleMethodInvocationStatement"])
    return _in_reach(b).match(f"?m {name} ?n", "?m inTypeDeclaration ?u")


@rule("simple_ivk0", *_CALL)
def _(b: B) -> B:
    return _uncalled(_method(_simple(b, "extendedName").match("?m nParameters 0"), "MethodDeclaration"))


@rule("simple_ivkx", *_CALL)
def _(b: B) -> B:
    b = _simple(b, "name").match("?x nArguments ?nargs", "?args a Arguments", "?m nParameters ?nparams")
    return _uncalled(_applicable(_method(b, "MethodDeclaration")))


@rule("simple_ivk", *_CALL)
def _(b: B) -> B:
    """Only where a class and what it extends hold a single candidate."""
    c = b.match("?m a MethodDeclaration", "?m child5 ?body", "?m extendedName ?n", "?m inTypeDeclaration ?u", "?t subClassOf* ?u", "?t a TypeDeclaration", "?t version ?v", "?u version ?v")
    b = c.only_one(["n", "t"], "m").match("?x extendedName ?n", "?x a Invocation", "?x a! ?kind").values("kind", ["SimpleMethodInvocation", "SimpleMethodInvocationStatement"])
    return _uncalled(_method(b.match("?x inTypeDeclaration+ ?t"), "MethodDeclaration"))


def _offered(b: B) -> B:
    """Methods ?m without parameters, named ?n, that a type ?t offers: its own, inherited ones, and those of types around it."""
    b = b.match("?m a MethodDeclaration", "?m name ?n", "?m nParameters 0", "?m inTypeDeclaration ?u", "?u version ?v", "?t1 subTypeOf* ?u", "?t1 version ?v")
    inner = b.match("?t inTypeDeclaration+ ?t1", "?t a TypeDeclaration", "?t version ?v", "?t fullyQualifiedName ?tq")
    own = b.bind("t", "t1").match("?t fullyQualifiedName ?tq")
    columns = ["m", "n", "t", "tq", "v"]
    return own.distinct(*columns).plus(inner.distinct(*columns)).distinct(*columns)


@rule("type_ivk0", *_CALL)
def _(b: B) -> B:
    b = _offered(b).match("?m child5 ?body").bind("whole", "concat(tq, '.', n)").match("?x name ?whole", "?x a Invocation", "?x nArguments 0", "?x inTypeDeclaration/version ?v")
    return _uncalled(_method(b.match("?x a ?kind").values("kind", ["TypeMethodInvocation", "TypeMethodInvocationStatement"]), "MethodDeclaration"))


@rule("primary_ivk0", *_CALL)
def _(b: B) -> B:
    b = _offered(b).match("?e ofReferenceType ?t", "?e a Primary", "?e parent ?x", "?x name ?n", "?x nArguments 0", "?x child2 ?args", "?args a Arguments")
    return _uncalled(_method(b.match("?x a ?kind").values("kind", ["PrimaryMethodInvocation", "PrimaryMethodInvocationStatement"]), "MethodDeclaration"))


def _creations(b: B, ways: tuple[int, ...]) -> B:
    """Instance creations ?x and constructors ?m by name: 0 as it is, 1 with the package or an import on demand in front, 2 as an inner class of a super class."""
    c = b.match("?m a ConstructorDeclaration", "?m name ?mn", "?m inTypeDeclaration ?t", "?m nParameters ?nparams", "?t version ?v", "?t name ?tn", "?t fullyQualifiedName ?tq")
    c = c.bind("whole", "concat(tq, '.', mn)").bind("short", "concat(tn, '.', mn)").distinct("m", "v", "whole", "short", "nparams")
    x = b.match("?x a InstanceCreation", "?x nArguments ?nargs", "?x name ?short", "?x inTypeDeclaration ?own", "?own version ?v")
    found, columns = [], ["x", "m", "v", "nargs", "nparams"]
    if 0 in ways:
        found.append(x.bind("whole", "short").distinct("x", "nargs", "v", "whole").join(c.distinct("m", "v", "whole", "nparams")))
    if 1 in ways:
        y = x.match("?own inFile ?f").either(["?p parent/inFile ?f", "?p a PackageDeclaration", "?p name ?pn"], ["?p parent/parent/inFile ?f", "?p a TypeImportOnDemandDeclaration", "?p name ?pn"])
        found.append(y.bind("whole", "concat(pn, '.', short)").distinct("x", "nargs", "v", "whole", "short").join(c))
    if 2 in ways:
        y = x.match("?own inFile ?f", "?own subClassOf+ ?u", "?u version ?v", "?nested inTypeDeclaration ?u", "?nested a TypeDeclaration", "?nested name ?inn", "?u name ?un", "?p parent/inFile ?f", "?p a PackageDeclaration", "?p name ?pn")
        y = y.where("short = concat(inn, '.<init>')").bind("whole", "concat(pn, '.', un, '$', short)")
        found.append(y.distinct("x", "nargs", "v", "whole", "short").join(c))
    out = found[0].distinct(*columns)
    for one in found[1:]:
        out = out.plus(one.distinct(*columns))
    return out.distinct(*columns)


@rule("new_ivk0", *_CALL)
def _(b: B) -> B:
    return _uncalled(_method(_creations(b, (0, 1, 2)).where("nargs = '0' and nparams = '0'"), "ConstructorDeclaration"))


for _name, _ways in (("new_ivkx", (0, 1, 2)), ("new_ivkx0", (0,)), ("new_ivkx1", (1,)), ("new_ivkx2", (2,))):
    rule(_name, *_CALL)(lambda b, ways=_ways: _uncalled(_applicable(_method(_creations(b, ways).match("?args parent ?x", "?args a Arguments"), "ConstructorDeclaration"))))


@rule("declared_by_field0-1", "?x declaredBy ?d")
def _(b: B) -> B:
    b = _in_reach(_own_access(b, "?x inTypeDeclaration ?t").distinct("x", "n", "t")).distinct("x", "n", "u")
    return b.match("?fd inTypeDeclaration ?u", *_FIELD).unless("?x declaredBy ?any")


@rule("declared_by_field2", "?x declaredBy ?d")
def _(b: B) -> B:
    """By the field's full name, with ``$`` or ``.`` between types, in the version; or by its name within its own type."""
    f = b.match("?d a VariableDeclarator", "?d parent ?fd", "?d name ?fn", "?fd a FieldDeclaration", "?fd inTypeDeclaration ?t", "?t a TypeDeclaration", "?t fullyQualifiedName ?q")
    wide = f.each("n", ["concat(q, '.', fn)", "concat(translate(q, '$', '.'), '.', fn)"]).match("?t version ?v", "?x name ?n", "?x a Name", "?x inTypeDeclaration/version ?v")
    near = f.bind("n", "fn").match("?x name ?n", "?x a Name", "?x inTypeDeclaration ?t")
    return wide.distinct("x", "d").plus(near.distinct("x", "d")).distinct("x", "d").unless("?x declaredBy ?any")


@rule("resolved_type_ivk", "?x name ?whole")
def _(b: B) -> B:
    b = b.match("?m a MethodDeclaration", "?m name ?mn", "?m fullyQualifiedName ?q", "?m nParameters ?k", "?m inTypeDeclaration ?t", "?t inSourceTree ?tree", "?t name ?tn", "?t inFile ?f", "?p parent/inFile ?f", "?p a PackageDeclaration", "?p name ?pn")
    b = b.bind("n", "concat(tn, '.', mn)").bind("whole", "translate(q, '$', '.')").where("whole = concat(pn, '.', n)").distinct("pn", "whole", "tree", "k", "n")
    b = b.match("?x name ?n", "?x a Invocation", "?x nArguments ?k", _TREE, "?x a ?kind").values("kind", ["TypeMethodInvocation", "TypeMethodInvocationStatement"])
    return b.match("?x inTypeDeclaration/inFile ?g", "?r parent/inFile ?g", "?r a PackageDeclaration", "?r name ?pn")


@rule("reftype_of_expr", "?x ofReferenceType ?t")
def _(b: B) -> B:
    """What the three rules for array accesses, parentheses and field accesses give together."""
    first, *others = (RULES[name].body(b).distinct("x", "t") for name in ("reftype_of_expr0", "reftype_of_expr1", "reftype_of_expr2"))
    for one in others:
        first = first.plus(one)
    return first.distinct("x", "t")


# --- qualified calls and field accesses -------------------------------------------------------------


def _kinds(b: B, kind: str) -> B:
    """Invocations of a kind, as an expression or as a statement."""
    return b.match("?x a ?kind").values("kind", [f"{kind}MethodInvocation", f"{kind}MethodInvocationStatement"])


def _inherited(b: B, *more: str) -> B:
    """Methods ?m with their extended names ?en and each class ?t of the version that is theirs or below it."""
    b = b.match("?m a MethodDeclaration", "?m extendedName ?en", "?m inTypeDeclaration ?u", *more, "?t subClassOf* ?u", "?t version ?v", "?u version ?v")
    return b


@rule("primary_ivk", *_CALL)
def _(b: B) -> B:
    """Only where a class and what it extends hold a single candidate."""
    b = _inherited(b, "?m child0 ?mods").only_one(["en", "t"], "m").match("?e ofReferenceType ?t", "?e a Expression", "?x child0 ?e", "?x extendedName ?en", "?t version ?v", "?x inTypeDeclaration/version ?v")
    b = b.match("?x a! ?kind").values("kind", ["PrimaryMethodInvocation", "PrimaryMethodInvocationStatement"])
    return _uncalled(_method(b, "MethodDeclaration"))


@rule("type_ivk", *_CALL)
def _(b: B) -> B:
    """The same for calls on a type's name; interfaces' methods don't count."""
    c = _inherited(b).unless("?u a InterfaceDeclaration").match("?t fullyQualifiedName ?tq").bind("whole", "concat(tq, '.', en)").only_one(["whole", "t"], "m")
    return _uncalled(_method(_kinds(c.match("?t version ?v", "?x extendedName ?whole", "?x inTypeDeclaration/version ?v"), "Type"), "MethodDeclaration"))


def _reached(b: B, *more: str) -> B:
    """Methods ?m named ?n with ?nparams parameters that a type ?t of their version offers: its own, inherited ones, and those of types around it."""
    b = b.match("?m a MethodDeclaration", "?m name ?n", "?m nParameters ?nparams", "?m inTypeDeclaration ?u", *more, "?u version ?v", "?t1 subTypeOf* ?u", "?t1 version ?v")
    own = b.match("?t1 fullyQualifiedName ?tq").bind("t", "t1")
    inner = b.match("?t inTypeDeclaration+ ?t1", "?t a TypeDeclaration", "?t version ?v", "?t fullyQualifiedName ?tq")
    columns = ["m", "n", "nparams", "t", "tq", "v"]
    return own.distinct(*columns).plus(inner.distinct(*columns)).distinct(*columns)


@rule("primary_ivkx", *_CALL)
def _(b: B) -> B:
    b = _reached(b).match("?e ofReferenceType ?t", "?e a Primary", "?e parent ?x", "?x name ?n")
    return _uncalled(_applicable(_method(_kinds(b, "Primary").match("?x nArguments ?nargs", "?x child2 ?args", "?args a Arguments"), "MethodDeclaration")))


@rule("type_ivkx", *_CALL)
def _(b: B) -> B:
    """Any child may hold the arguments."""
    b = _reached(b, "?m child5 ?body").bind("whole", "concat(tq, '.', n)").match("?x name ?whole", "?x a Invocation", "?x inTypeDeclaration/version ?v")
    return _uncalled(_applicable(_method(_kinds(b, "Type").match("?x nArguments ?nargs", "?x child ?args"), "MethodDeclaration")))


@rule("resolved_name", "?x a Name", "?x name ?whole")
def _(b: B) -> B:
    """An ambiguous name whose qualifier is an imported type that has such a field or constant, or inherits it."""
    b = _ambiguous(b.match("?x a AmbiguousName", "?x inTypeDeclaration/inFile ?f", "?x name ?xn", "?x identifier ?id", "?x qualifier ?qn", "?f a File", "?f version ?v"))
    b = b.match("?t name ?qn", "?t version ?v", "?t a TypeDeclaration", "?t fullyQualifiedName ?q").bind("cq", "translate(q, '$', '.')")
    b = b.match("?i parent/parent/inFile ?f", "?i a ImportDeclaration", "?i name ?in_").where("concat(in_, '.', qn) = cq")
    above = ["?t subTypeOf* ?u", "?t version ?v", "?u version ?v"]
    b = b.flag("field_", "?d a VariableDeclarator", "?d inField ?fd", "?d name ?id", "?fd a FieldDeclaration", "?fd inTypeDeclaration ?u", *above)
    b = b.flag("constant_", "?d a EnumConstant", "?d name ?id", "?d inEnum ?u", *above).where("field_ or constant_")
    return b.bind("whole", "concat(cq, '.', id)")


@rule("resolved_type_ivk_static", "?x a ?cat", "?x name ?whole")
def _(b: B) -> B:
    """Calls of methods that a static import on demand brings in."""
    b = b.match("?m a MethodDeclaration", "?m inTypeDeclaration ?t0", "?m name ?n", "?m fullyQualifiedName ?q", "?m nParameters ?k", "?t0 inSourceTree ?tree", "?t0 fullyQualifiedName ?cq", "?t0 name ?tn", "?t0 inFile ?f0", "?p parent/inFile ?f0", "?p a PackageDeclaration", "?p name ?pn")
    b = b.bind("whole", "translate(q, '$', '.')").distinct("whole", "tree", "k", "n", "cq")
    b = b.match("?x name ?n", "?x a Invocation", "?x nArguments ?k", "?x inTypeDeclaration ?t", "?t inSourceTree ?tree", "?t inFile ?f", "?i parent/parent/inFile ?f", "?i a StaticImportOnDemandDeclaration", "?i name ?cq")
    return b.flag("statement_", "?x a Statement").bind("cat", "CASE WHEN statement_ THEN 'TypeMethodInvocationStatement' ELSE 'TypeMethodInvocation' END")


_REFERENCE_FIELD = [*_FIELD, "?fd child1 ?ty", "?ty a ReferenceType", "?ty parent ?fd", "?ty name ?tn", "?ty refersToDeclaration ?td"]


@rule("reftype_of_field_access", "?x ofReferenceType ?td", "?x typeName ?tn", "?x typeDims ?dims", "?x declaredBy ?d")
def _(b: B) -> B:
    """By the field of the type of what is in front, of a type around it, or of a super type of these, in one source tree."""
    b = b.match("?x a FieldAccess", "?x name ?n", "?x child0 ?e", "?e a Expression", "?e ofReferenceType ?t").distinct("x", "n", "t")
    b = b.match("?t inSourceTree ?tree", "?t inTypeDeclaration* ?t1", "?t1 subTypeOf* ?t0", "?t0 inSourceTree ?tree").distinct("x", "n", "t0")
    return _untyped(b.match("?fd inTypeDeclaration ?t0", *_REFERENCE_FIELD).optional("?ty dimensions ?dims"))


@rule("reftype_of_local_field_access", "?x ofReferenceType ?td", "?x typeName ?tn", "?x typeDims ?dims")
def _(b: B) -> B:
    b = _own_access(b, "?x inTypeDeclaration ?t", "?x declaredBy ?d").distinct("x", "n", "d")
    return _untyped(b.match("?fd inTypeDeclaration ?t0", *_REFERENCE_FIELD).optional("?ty dimensions ?dims"))


@rule("type_of_field_access", "?x typeName ?name_", "?x typeDims ?dims", "?x declaredBy ?d")
def _(b: B) -> B:
    b = b.match("?x a FieldAccess", "?x name ?n", "?x child0 ?e", "?e a Expression", "?e ofReferenceType ?t0").distinct("x", "n", "t0")
    b = b.match("?t0 version ?v", "?t0 inTypeDeclaration* ?t1", "?t1 version ?v", "?t1 subTypeOf* ?t", "?t version ?v").distinct("x", "n", "t")
    b = b.match("?fd inTypeDeclaration ?t", "?fd a FieldDeclaration", "?fd child2 ?d", "?d name ?n", "?fd child1 ?ty", "?ty a Type")
    return _nameless(_type_name(b).optional("?ty dimensions ?dims"))


@rule("type_of_local_field_access", "?x typeName ?name_", "?x typeDims ?dims")
def _(b: B) -> B:
    """Accesses with ``this`` below them, or with nothing."""
    b = b.match("?x a FieldAccess", "?x name ?n", "?x declaredBy ?d").flag("on_this", "?q parent ?x", "?q a This").flag("qualified", "?q2 parent ?x").where("on_this or not qualified")
    b = b.match("?x inTypeDeclaration/version ?v").distinct("x", "n", "d", "v").match(*_FIELD, "?fd inTypeDeclaration ?t", "?t version ?v", "?fd child1 ?ty", "?ty a Type", "?ty parent ?fd")
    return _nameless(_type_name(b).optional("?ty dimensions ?dims"))


# The order in which rules run.  The second list is run three times, as names, types and
# calls feed one another.  Rules in none of the lists are run by name only.
FIRST = """
tdecl_in_srctree file_mapping stmt_level0 stmt_level
pruned_tdecl pruned_super_type pruned_method pruned_field pruned_field_access pruned_name pruned_enum_const pruned_invocation pruned_import pruned_param
grafted_tdecl grafted_super_type grafted_method grafted_field grafted_field_access grafted_name grafted_enum_const grafted_invocation grafted_import grafted_param
resolved_reftype resolved_tyvar resolved_type_ivk_pe resolved_type_ivk_ps resolved_type_ivk resolved_type_ivk_static
class_hierarchy interface_hierarchy class_name_hierarchy resolved_enum_const resolved_facc0 refers_to_decl
tdecl_mapped_eq tdecl_modified stable_mapping return_reftype return_type reftype_of_new0
declared_by_field0-0-0 declared_by_field0-0-1 declared_by_field0-0-2 declared_by_field0-1 declared_by_catch_param declared_by_for_header
reftype_of_enum_const reftype_of_cast reftype_of_declared_var reftype_of_var_declared_by_param reftype_of_local_field_access
type_of_enum_const type_of_cast type_of_literal type_of_declared_var type_of_var_declared_by_param type_of_local_field_access
param_ty param_ty_name simple_ivk0 super_ivk0 this_ivk0 new_ivk0
""".split()
AGAIN = """
resolved_name resolved_facc
reftype_of_this reftype_of_ivk reftype_of_new reftype_of_expr0 reftype_of_expr1 reftype_of_expr2 reftype_of_field_access
type_of_this type_of_uop type_of_bop type_of_array_access type_of_ivk type_of_new type_of_field_access
simple_ivkx primary_ivk0 primary_ivkx type_ivk0 type_ivkx new_ivkx0 new_ivkx1 new_ivkx2 super_ivkx this_ivkx
""".split()
LAST = ["declared_by_field2"]
ROUNDS = 3


def materialize_java(store) -> int:
    """All rules in run order; returns the number of new facts."""
    from .rules import Agenda, materialize

    agenda = Agenda(store)
    return sum(materialize(store, [RULES[n] for n in names], rounds, agenda) for names, rounds in ((FIRST, 1), (AGAIN, ROUNDS), (LAST, 1)))
