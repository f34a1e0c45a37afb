"""A query for each rule over facts about a small Java-like program, one copy a nation, each with its DuckDB twin.

Every fact is left out of some copies, so that conditions fail here and there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..lenses import table
from ..plans import javarules
from ..plans.infer import Ontology
from ..plans.store import FactStore
from ..session import shared_root
from . import Catalog
from .twins import rule_sql

CATALOG = Catalog()

CLASSES = """
ClassDeclaration TypeDeclaration
InterfaceDeclaration TypeDeclaration
EnumDeclaration TypeDeclaration
TypeDeclaration Entity
MethodDeclaration MethodOrConstructor
ConstructorDeclaration MethodOrConstructor
SimpleMethodInvocation Invocation
PrimaryMethodInvocation Invocation
PrimaryMethodInvocation Primary
TypeMethodInvocation Invocation
PrimaryMethodInvocationStatement Invocation
PrimaryMethodInvocationStatement Statement
SimpleMethodInvocationStatement Invocation
SimpleMethodInvocationStatement Statement
TypeMethodInvocationStatement Invocation
TypeMethodInvocationStatement Statement
Invocation InvocationOrInstanceCreation
InstanceCreation InvocationOrInstanceCreation
StandardInstanceCreation InstanceCreation
InstanceCreation Primary
IntType PrimitiveType
PrimitiveType Type
ReferenceType Type
IfStatement Statement
EnhancedForStatement Statement
FieldAccess Primary
This Primary
Primary Expression
SingleTypeImportDeclaration ImportDeclaration
TypeImportOnDemandDeclaration ImportDeclaration
StaticImportOnDemandDeclaration ImportDeclaration
"""

# Of a type that is in one version only: %T, the type, in file %F, in source tree %S, which %P relates to the other tree %O.
LONE = """
%F a File
%F inSourceTree %S
%F %P %O
%T a EnumDeclaration
%T inFile %F
%T fullyQualifiedName p.%T
%T.c a EnumConstant
%T.c inEnum %T
%T.c name RED
%T.m a MethodDeclaration
%T.m inTypeDeclaration %T
%T.n a Name
%T.n inTypeDeclaration %T
%T.i a SimpleMethodInvocation
%T.i inTypeDeclaration %T
%T.a a FieldAccess
%T.a inTypeDeclaration %T
%T.fd a FieldDeclaration
%T.fd inTypeDeclaration %T
%T.fx parent %T.fd
%T.u inFile %F
%T.is parent %T.u
%T.im a SingleTypeImportDeclaration
%T.im parent %T.is
%T.p a Parameter
%T.p inTypeDeclaration %T
%T.pt a ReferenceType
%T.pt parent %T.p
%T.hd parent %T
%T.ex a Implements
%T.ex parent %T.hd
%T.et a ReferenceType
%T.et parent %T.ex
"""

PROGRAM = """
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
unit inFile f0
pkg a PackageDeclaration
pkg parent unit
pkg name p
A a ClassDeclaration
A inFile f0
A inSourceTree tree0
A version v0
A name A
A fullyQualifiedName p.A
A treeDigest ta
A mappedTo A1
A1 a ClassDeclaration
A1 inFile f1
A1 fullyQualifiedName p.A
A1 treeDigest tb
B a ClassDeclaration
B inFile f0
B version v0
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
D a ClassDeclaration
D inFile f0
D inSourceTree tree0
D version v0
D name D
D fullyQualifiedName p.D
D subClassOf A
I a InterfaceDeclaration
I inFile f0
I version v0
I fullyQualifiedName p.I
Iext a ExtendsInterfaces
Iext inTypeDeclaration I
Ity a ReferenceType
Ity parent Iext
Ity name p.J
J a InterfaceDeclaration
J inFile f0
J version v0
J fullyQualifiedName p.J
In a ClassDeclaration
In inFile f0
In inSourceTree tree0
In inTypeDeclaration A
In version v0
In name In
In fullyQualifiedName p.A$In
late a TypeDeclaration
late inFile f0
tps a TypeParameters
hd child1 tps
A child0 hd
tp a TypeParameter
tp parent tps
tp name T
tp child1 tb
tb a TypeBound
tb child0 tbt
tbt name p.Bound
tyv a ReferenceType
tyv inTypeDeclaration A
tyv name T
short a ReferenceType
short unqualifiedName A
short name A
short inTypeDeclaration D
m a MethodDeclaration
m inTypeDeclaration A
m child2 mty
mty a IntType
mty parent m
mty dimensions 1
IntType label int
m child3 ps
ps a Parameters
ps child0 par
par a Parameter
par name x
par child1 pty
par dimensions 1
pty a ReferenceType
pty name p.B
pty parent par
m2 a MethodDeclaration
m2 child2 m2ty
m2ty a ReferenceType
m2ty parent m2
m2ty name p.D
m2ty refersToDeclaration D
use a Name
use name e
use parent inner
inner parent body
catch a CatchClause
catch child0 cp
catch child1 body
cp a CatchParameter
cp name e
loop a EnhancedForStatement
loop child0 fh
loop child2 lbody
fh a ForHeader
fh name i
luse a Name
luse name i
luse parent lbody
fd a FieldDeclaration
fd inTypeDeclaration A
fd child1 fty
fd child2 vd
fty a ReferenceType
fty parent fd
fty name p.D
fty refersToDeclaration D
fty dimensions 1
vd a VariableDeclarator
vd parent fd
vd inField fd
vd name k
fd2 a FieldDeclaration
fd2 inTypeDeclaration A
fd2 child1 f2ty
fd2 child2 vd2
f2ty a IntType
f2ty parent fd2
vd2 a VariableDeclarator
vd2 parent fd2
vd2 name n
acc a FieldAccess
acc name k
acc inTypeDeclaration A
acc child0 self
self a This
self inTypeDeclaration A
dacc a FieldAccess
dacc name k
dacc inTypeDeclaration D
lacc a FieldAccess
lacc name k
lacc inTypeDeclaration A
lacc declaredBy vd
l2acc a FieldAccess
l2acc name n
l2acc inTypeDeclaration A
l2acc declaredBy vd2
other a FieldAccess
other name k
other inTypeDeclaration D
other child0 expr
expr a This
expr inTypeDeclaration D
expr ofReferenceType D
other2 a FieldAccess
other2 name n
other2 child0 expr
anew a InstanceCreation
anew ofReferenceType A
anew typeName p.A
anacc a FieldAccess
anacc name k
anacc inInstanceCreation anew
anfd a FieldDeclaration
anfd inInstanceCreation anew
anfd child2 anvd
anvd a VariableDeclarator
anvd parent anfd
anvd name z
anacc2 a FieldAccess
anacc2 name z
anacc2 inInstanceCreation anew
anst inInstanceCreation anew
anthis a This
anthis inStatement anst
full a Name
full name p.A.k
full inTypeDeclaration D
near a Name
near name k
near inTypeDeclaration A
E a EnumDeclaration
E inTypeDeclaration A
E inSourceTree tree0
E version v0
E name E
E fullyQualifiedName p.A$E
Ec a EnumConstant
Ec inEnum E
Ec name RED
euse inTypeDeclaration D
euse name E.RED
efull a Name
efull name p.A$E.RED
efull inTypeDeclaration D
amb a AmbiguousName
amb name x.y
amb identifier y
amb child0 acc
amb0 a AmbiguousName
amb0 name k
amb0 inTypeDeclaration D
ambn a AmbiguousName
ambn inTypeDeclaration D
ambn name A.k
ambn identifier k
ambn qualifier A
impst parent unit
imp a SingleTypeImportDeclaration
imp parent impst
imp name p
simp a StaticImportOnDemandDeclaration
simp parent impst
simp name p.A
s1 a IfStatement
s1 parent mb
s1 inTypeDeclaration A
s1 stmtLevel 0
s0 a IfStatement
s0 parent mb
s0 inTypeDeclaration A
s0 mappedTo s9
mb a MethodBody
s2 a IfStatement
s2 inStatement s1
s3 a IfStatement
s3 inStatement s2
s1 mappedTo t1
t2 mappedTo s2
s3 mappedTo t3
lit a IntegerLiteral
lit2 a IntegerLiteral
lit2 typeName int
strl a StringLiteral
strl typeName java.lang.String
strl typeDims 0
bop a BinaryOp
bop child0 lit2
bop child1 strl
uop a UnaryOp
uop child0 lit2
cast a Cast
cast child0 cty
cast inTypeDeclaration A
cty a ReferenceType
cty name p.D
aacc a ArrayAccess
aacc child0 arr
arr typeName p.T[]
arr typeDims 2
arr ofReferenceType D
par1 a ParenthesizedExpression
par1 child0 expr
sic a StandardInstanceCreation
sic child1 sicty
sicty name p.A
actor a ConstructorDeclaration
actor inTypeDeclaration A
actor inClass A
actor name <init>
actor nParameters 0
actor fullyQualifiedName p.A.<init>
actor signature ()V
cc a ConstructorDeclaration
cc inTypeDeclaration A
cc name <init>
cc nParameters 2
cc fullyQualifiedName p.A.<init>
cc signature (I,A)V
cc parameterTypeName0 int
cc parameterTypeName1 p.A
cv a ConstructorDeclaration
cv inTypeDeclaration A
cv name <init>
cv nParameters 1
cv isVariableArityMethod true
cv fullyQualifiedName p.A.<init>
cv signature ([I)V
cv parameterTypeName0 int
ictor a ConstructorDeclaration
ictor inTypeDeclaration In
ictor name <init>
ictor nParameters 0
ictor fullyQualifiedName p.A$In.<init>
ictor signature ()V
ictorx a ConstructorDeclaration
ictorx inTypeDeclaration In
ictorx name <init>
ictorx nParameters 1
ictorx fullyQualifiedName p.A$In.<init>
ictorx signature (I)V
ictorx parameterTypeName0 int
dctor a ConstructorDeclaration
dctor inTypeDeclaration D
dctor nParameters 0
sup a SuperInvocation
sup inConstructor dctor
sup child1 noargs
ths a ThisInvocation
ths inConstructor cc
ths child1 noargs
two child0 lit2
two child1 ofd
two a Arguments
ofd ofReferenceType D
three a Arguments
three child0 lit2
three child1 lit2
three child2 lit2
one a Arguments
one child0 lit2
supx a SuperInvocation
supx inConstructor dctor
supx nArguments 2
supx child1 two
thsx a ThisInvocation
thsx inConstructor actor
thsx nArguments 2
thsx child1 two
thsv a ThisInvocation
thsv inConstructor actor
thsv nArguments 3
thsv child1 three
new0 a InstanceCreation
new0 nArguments 0
new0 name p.A.<init>
new0 inTypeDeclaration D
new1 a InstanceCreation
new1 nArguments 0
new1 name A.<init>
new1 inTypeDeclaration D
new2 a InstanceCreation
new2 nArguments 0
new2 name In.<init>
new2 inTypeDeclaration D
newx a InstanceCreation
newx nArguments 2
newx name p.A.<init>
newx inTypeDeclaration D
nx parent newx
nx a Arguments
nx child0 lit2
nx child1 ofd
newx1 a InstanceCreation
newx1 nArguments 2
newx1 name A.<init>
newx1 inTypeDeclaration D
nx1 parent newx1
nx1 a Arguments
nx1 child0 lit2
nx1 child1 ofd
newx2 a InstanceCreation
newx2 nArguments 1
newx2 name In.<init>
newx2 inTypeDeclaration D
nx2 parent newx2
nx2 a Arguments
nx2 child0 lit2
made a InstanceCreation
made mayInvokeMethod actor
run a MethodDeclaration
run inTypeDeclaration A
run name run
run extendedName run#0
run nParameters 0
run child0 rmods
run child5 rbody
run fullyQualifiedName p.A.run
run signature ()V
run returnType D
run returnTypeName p.D
run returnTypeDims 0
go a MethodDeclaration
go inTypeDeclaration A
go name go
go extendedName go#1
go nParameters 1
go child0 gmods
go child5 gbody
go fullyQualifiedName p.A.go
go signature (I)V
go parameterTypeName0 int
call a SimpleMethodInvocation
call inTypeDeclaration D
call extendedName run#0
call name run
call child1 noargs
callx a SimpleMethodInvocation
callx inTypeDeclaration D
callx extendedName go#1
callx name go
callx nArguments 1
callx child1 one
callin a SimpleMethodInvocationStatement
callin inTypeDeclaration In
callin extendedName run#0
callin name run
callin nArguments 0
done a SimpleMethodInvocation
done mayInvokeMethod run
expr parent pcall
pcall a PrimaryMethodInvocation
pcall inTypeDeclaration D
pcall name run
pcall extendedName run#0
pcall nArguments 0
pcall child0 expr
pcall child2 pargs
pargs a Arguments
expr parent pcallx
pcallx a PrimaryMethodInvocationStatement
pcallx inTypeDeclaration D
pcallx name go
pcallx extendedName go#1
pcallx nArguments 1
pcallx child0 expr
pcallx child2 one
tcall a TypeMethodInvocation
tcall inTypeDeclaration D
tcall name p.A.run
tcall extendedName p.A.run#0
tcall nArguments 0
tcallx a TypeMethodInvocationStatement
tcallx inTypeDeclaration D
tcallx name p.D.go
tcallx extendedName p.D.go#1
tcallx nArguments 1
tcallx child1 one
tshort a TypeMethodInvocation
tshort inTypeDeclaration D
tshort name A.run
tshort nArguments 0
pe a PrimaryMethodInvocation
pe name run
pe child0 pename
pename name A
pst a PrimaryMethodInvocationStatement
pst name run
pst child0 pename
svar a Name
svar name w
svar inTypeDeclaration A
svar declaredBy wvd
wvd a VariableDeclarator
wvd inVariableDeclaration wdecl
wty a ReferenceType
wty parent wdecl
wty name p.D
wty refersToDeclaration D
wty dimensions 2
pvar a Name
pvar name x
pvar inTypeDeclaration A
pvar inMethodOrConstructor m
pvar declaredBy par2
par2 a Parameter
par2 name x
p2ty a ReferenceType
p2ty parent par2
p2ty name p.D
p2ty dimensions 1
"""


def _text() -> str:
    lone = ""
    for names in (("G", "gone", "tree0", "prunedFrom", "tree1"), ("N", "new", "tree1", "graftedOnto", "tree0")):
        one = LONE
        for mark, name in zip(("%T", "%F", "%S", "%P", "%O"), names):
            one = one.replace(mark, name)
        lone += one
    return (PROGRAM + lone).strip().replace("\n\n", "\n")


TEXT = _text()
LINES = TEXT.split("\n")
SUBJECTS = sorted({line.split(" ")[0] for line in LINES} | {line.split(" ")[2] for line in LINES if line.split(" ")[1] in ("parent", "child0", "child1", "child2", "child5", "inFile", "version", "mappedTo", "next", "inStatement")})
ONTOLOGY = Ontology(classes=[tuple(line.split()) for line in CLASSES.strip().split("\n")])
#: Predicates whose objects are never nodes.
LITERAL = ["a", "name", "unqualifiedName", "qualifier", "identifier", "extendedName", "fullyQualifiedName"]
#: A fact is missing in a copy where 7 times its place plus 3 times the copy's key leaves 0 by this number.
MISSING = 97

FACTS_SQL = f"""
x AS (SELECT n_nationkey AS k, unnest(string_split({chr(39)}{TEXT}{chr(39)}, chr(10))) AS line, unnest(range({len(LINES)})) AS i FROM nation),
y AS (SELECT k, string_split(line, ' ') AS w FROM x WHERE (7 * i + 3 * k) % {MISSING} <> 0),
t AS (SELECT DISTINCT w[1] || '_' || k AS s, w[2] AS p, CASE WHEN w[2] NOT IN ({', '.join(f"'{x}'" for x in LITERAL)}) AND w[3] IN ({', '.join(f"'{x}'" for x in SUBJECTS)}) THEN w[3] || '_' || k ELSE w[3] END AS o FROM y
  UNION SELECT 'IntType', 'label', 'int')
"""


def java_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts (s, p, o): the program's lines for each nation, nodes with its key behind."""
    lines = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.posexplode(F.split(F.lit(TEXT), "\n")).alias("i", "line"))
    w = lines.filter((7 * F.col("i") + 3 * F.col("k")) % MISSING != 0).select("k", F.split("line", " ").alias("w"))
    own = lambda c: F.concat_ws("_", c, F.col("k").cast("string"))
    s, p, o = (F.col("w")[i] for i in range(3))
    facts = w.select(own(s).alias("s"), p.alias("p"), F.when(~p.isin(LITERAL) & o.isin(SUBJECTS), own(o)).otherwise(o).alias("o"))
    return facts.unionByName(spark.createDataFrame([("IntType", "label", "int")], "s string, p string, o string"))


_STORES: dict[tuple, FactStore] = {}


def java_store(spark: SparkSession, sf_dir: str) -> FactStore:
    """Written once for an application and shared folder: the rules' queries only read it."""
    key = spark.sparkContext.applicationId, shared_root(spark), sf_dir
    if key not in _STORES:
        _STORES[key] = FactStore.of(java_facts(spark, sf_dir), ONTOLOGY)
    return _STORES[key]


def _query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = java_store(spark, sf_dir)
        return store.new(javarules.RULES[name].facts(store))

    return run


for _n, _name in enumerate(sorted(javarules.RULES), 1):
    CATALOG.add(f"r_{_name.replace('-', '_')}", rule_sql(javarules.RULES[_name], ONTOLOGY, FACTS_SQL))(_query(_name))
