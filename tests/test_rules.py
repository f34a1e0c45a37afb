"""Rules on a small factbase written by hand."""

import pytest

from palimpsest.plans import javarules
from palimpsest.plans.closure import closure
from palimpsest.plans.infer import Ontology
from palimpsest.plans.pattern import Bindings, Paths
from palimpsest.plans.rules import materialize
from palimpsest.plans.store import FactStore

CLASSES = [("SimpleMethodInvocation", "Invocation"), ("ClassDeclaration", "TypeDeclaration"), ("InterfaceDeclaration", "TypeDeclaration"), ("EnumDeclaration", "TypeDeclaration"), ("MethodDeclaration", "MethodOrConstructor"), ("ConstructorDeclaration", "MethodOrConstructor"), ("IntType", "PrimitiveType"), ("PrimitiveType", "Type"), ("ReferenceType", "Type"), ("IfStatement", "Statement"), ("TypeDeclaration", "Entity"), ("FieldAccess", "Expression"), ("This", "Expression")]

FACTS = """
v0 next v1
tree0 a SourceTree
tree0 version v0
tree1 a SourceTree
tree1 version v1
f0 a File
f0 inSourceTree tree0
f0 version v0
f0 fileDigest d0
f0 location A.java
f1 a File
f1 inSourceTree tree1
f1 version v1
f1 fileDigest d1
f1 location A.java
f0 modified f1
gone a File
gone inSourceTree tree0
gone prunedFrom tree1
new a File
new inSourceTree tree1
new graftedOnto tree0
A a ClassDeclaration
A inFile f0
A name A
A fullyQualifiedName p.A
A treeDigest ta
B a ClassDeclaration
B inFile f0
B name B
B fullyQualifiedName p.B
Bext a Extends
Bext inTypeDeclaration B
Bext parent Bclause
Bty a ReferenceType
Bty name p.A<T>
Bty unqualifiedName A
Bty parent Bext
Bty inTypeDeclaration B
A1 a ClassDeclaration
A1 inFile f1
A1 fullyQualifiedName p.A
A1 treeDigest tb
A mappedTo A1
G a EnumDeclaration
G inFile gone
G fullyQualifiedName p.G
Gc a EnumConstant
Gc inEnum G
Gc name RED
Gf a FieldDeclaration
Gf inTypeDeclaration G
Gx parent Gf
N a EnumDeclaration
N inFile new
Nc a EnumConstant
Nc inEnum N
m a MethodDeclaration
m inTypeDeclaration A
m child2 mty
mty a IntType
mty parent m
mty dimensions 1
m child3 ps
ps a Parameters
ps child0 par
par a Parameter
par name x
par child1 pty
pty a ReferenceType
pty name p.B
pty parent par
IntType label int
use a Name
use name e
use parent inner
inner parent body
catch a CatchClause
catch child0 cp
catch child1 body
cp a CatchParameter
cp name e
fd a FieldDeclaration
fd inTypeDeclaration A
fd child2 vd
vd a VariableDeclarator
vd parent fd
vd name k
acc a FieldAccess
acc name k
acc inTypeDeclaration A
acc child0 self
self a This
other a FieldAccess
other name k
other inTypeDeclaration A
other child0 expr
lit a IntegerLiteral
s1 a IfStatement
s1 parent mb
s1 inTypeDeclaration A
mb a MethodBody
s2 a IfStatement
s2 inStatement s1
s3 a IfStatement
s3 inStatement s2
s1 mappedTo t1
t2 mappedTo s2
s3 mappedTo t3
bop a BinaryOp
bop child0 lit
bop child1 str
str a StringLiteral
cast a Cast
cast child0 pty
aacc a ArrayAccess
aacc child0 arr
arr typeName p.T[]
arr typeDims 2
actor a ConstructorDeclaration
actor inTypeDeclaration A
actor nParameters 0
actor fullyQualifiedName p.A.<init>
actor signature ()V
bctor a ConstructorDeclaration
bctor inTypeDeclaration B
sup a SuperInvocation
sup inConstructor bctor
sup child1 args
cc a ConstructorDeclaration
cc inTypeDeclaration A
cc nParameters 2
cc fullyQualifiedName p.A.<init>
cc signature (I,B)V
cc parameterTypeName0 int
cc parameterTypeName1 p.A
cv a ConstructorDeclaration
cv inTypeDeclaration A
cv nParameters 1
cv isVariableArityMethod true
cv fullyQualifiedName p.A.<init>
cv signature ([I)V
cv parameterTypeName0 int
t2 a ThisInvocation
t2 inConstructor actor
t2 nArguments 2
t2 child1 t2a
t2a child0 lit
t2a child1 ofb
ofb parent t2a
ofb ofReferenceType B
t3 a ThisInvocation
t3 inConstructor actor
t3 nArguments 3
t3 child1 t3a
t3a child0 lit
t3a child1 lit
t3a child2 lit
lit parent t3a
t4 a ThisInvocation
t4 inConstructor actor
t4 nArguments 3
t4 child1 t4a
t4a child0 lit
t4a child1 lit
t4a child2 str
str parent t4a
call a SimpleMethodInvocation
call inTypeDeclaration B
call extendedName run#0
call child1 cargs
run a MethodDeclaration
run inTypeDeclaration A
run extendedName run#0
run nParameters 0
run fullyQualifiedName p.A.run
run signature ()V
bacc a FieldAccess
bacc name k
bacc inTypeDeclaration B
"""


@pytest.fixture(scope="module")
def store(spark):
    facts = [tuple(line.split()) for line in FACTS.strip().splitlines()]
    s = FactStore.of(spark.createDataFrame(facts, "s string, p string, o string"), Ontology(classes=CLASSES))
    names = [n for n in javarules.FIRST if n not in ("class_name_hierarchy", "resolved_tyvar")]
    materialize(s, [javarules.RULES[n] for n in names])
    materialize(s, [javarules.RULES[n] for n in ("type_of_bop", "type_of_cast", "type_of_array_access", "reftype_of_this", "super_ivk0", "this_ivkx")])
    return s


def objects(store, s, p):
    return {r["o"] for r in store.facts().filter(f"s = '{s}' and p = '{p}'").collect()}


def test_places_and_hierarchies(store):
    assert objects(store, "A", "inSourceTree") == {"tree0"} and objects(store, "A", "version") == {"v0"}
    assert objects(store, "B", "subClassOf") == {"A"}  # by the name without type arguments
    assert objects(store, "Bty", "refersToDeclaration") == {"A"}


def test_correspondence(store):
    assert objects(store, "A", "mappedEqTo") == {"A1"} and objects(store, "A", "modified") == {"A1"}
    assert objects(store, "f0", "mappedNeqTo") == {"f1"} and objects(store, "A", "mappedStablyTo") == {"A1"}


def test_pruned_and_grafted(store):
    assert objects(store, "G", "prunedFrom") == {"tree1"} and objects(store, "Gx", "prunedFrom") == {"tree1"}
    assert objects(store, "Gc", "prunedFrom") == set()  # the enum is written instead
    assert objects(store, "Nc", "graftedOnto") == {"tree0"}
    assert objects(store, "A", "prunedFrom") == set()


def test_types(store):
    assert objects(store, "m", "returnTypeName") == {"int"} and objects(store, "m", "returnTypeDims") == {"1"}
    assert objects(store, "m", "parameterTypeName0") == {"p.B"} and objects(store, "m", "parameterTypeDims0") == {"0"}
    assert objects(store, "lit", "typeName") == {"int"} and objects(store, "bop", "typeName") == {"int", "java.lang.String"}
    assert objects(store, "aacc", "typeName") == {"p.T"} and objects(store, "aacc", "typeDims") == {"1"}
    assert objects(store, "cast", "typeName") == set()


def test_declarations_and_calls(store):
    assert objects(store, "use", "declaredBy") == {"cp"}
    assert objects(store, "acc", "declaredBy") == {"vd"} and objects(store, "other", "declaredBy") == set()
    assert objects(store, "sup", "mayInvoke") == {"p.A.<init>()V"} and objects(store, "sup", "mayInvokeMethod") == {"actor"}


def test_overloads(store):
    assert objects(store, "t2", "mayInvokeMethod") == {"cc"}  # B is below A, and isn't an int
    assert objects(store, "t3", "mayInvokeMethod") == {"cv"} and objects(store, "t4", "mayInvokeMethod") == set()
    assert objects(store, "call", "mayInvoke") == {"p.A.run()V"}  # inherited
    assert objects(store, "bacc", "declaredBy") == {"vd"}


def test_statement_levels(store):
    assert [objects(store, s, "stmtLevel") for s in ("s1", "s2", "s3")] == [{"0"}, {"1"}, {"2"}]


def test_rules_again_add_nothing(store):
    n = store.count()
    assert materialize(store, [javarules.RULES[x] for x in ("tdecl_in_srctree", "class_hierarchy", "pruned_tdecl", "declared_by_catch_param", "stmt_level0")]) == 0
    assert store.count() == n == store.facts().distinct().count()


def test_every_rule_has_a_plan(store):
    paths = Paths(store)
    for r in javarules.RULES.values():
        assert r.facts(store, paths).columns == ["s", "p", "o"]
    assert set(javarules.FIRST + javarules.AGAIN + javarules.LAST) <= set(javarules.RULES)


def test_closure(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "x")], "s string, o string")
    got = lambda *x, **k: {tuple(r) for r in closure(e, *x, **k).collect()}
    assert got(1) == {(x, y) for x in "abc" for y in "abcd"}
    assert got(0) == {(x, y) for x in "abc" for y in "abcd"} | {("d", "d")}
    assert got(1, 2) == {("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "c"), ("b", "a"), ("b", "d"), ("c", "b")}
    assert ("a", "d", 3) in got(1, step="n") and ("a", "a", 3) in got(1, step="n")


def test_patterns_need_a_shared_variable(store):
    with pytest.raises(ValueError):
        Bindings(Paths(store)).match("?a inFile ?b", "?c version ?d")
