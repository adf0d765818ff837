"""Grammars of the supported languages, for recognition: precedence is left out where it does not change what is a sentence."""

JSON = r"""
json: value
value: "{" members? "}" | "[" values? "]" | STRING | NUMBER | "true" | "false" | "null"
members: STRING ":" value | members "," STRING ":" value
values: value | values "," value
"""

PYTHON = r"""
file: statement*
statement: simple | compound
simple: small (";" small)* ";"? NEWLINE
small: targets | targets "AUG" tests | targets assigned+ | chain ":" test ("=" tests)?
  | "pass" | "break" | "continue" | "return" tests? | "raise" (test ("from" test)?)?
  | "global" names | "nonlocal" names | "del" tests | "assert" test ("," test)?
  | "import" dotted_as ("," dotted_as)* | "from" origin "import" imported
  | "type" NAME typeparams? "=" test
assigned: "=" targets
targets: tests | yielded
yielded: "yield" tests? | "yield" "from" test
names: name ("," name)*
dotted: name | dotted "." name
dotted_as: dotted ("as" name)?
origin: dots? dotted | dots
dots: dots "." | dots "..." | "." | "..."
imported: "*" | "(" import_names ","? ")" | import_names
import_names: import_as | import_names "," import_as
import_as: name ("as" name)?
compound: "if" named ":" suite elifs otherwise?
  | "if" named ":" suite otherwise?
  | "while" named ":" suite otherwise?
  | "async"? "for" star_tests "in" tests ":" suite otherwise?
  | "try" ":" suite excepts otherwise? finally?
  | "try" ":" suite finally
  | "async"? "with" withitems ":" suite
  | "async"? "with" "(" withitems "," ")" ":" suite
  | "async"? "with" "(" withas ("," withas)* ","? ")" ":" suite
  | decorator* "async"? "def" name typeparams? "(" params? ")" ("->" test)? ":" suite
  | decorator* "class" name typeparams? ("(" args? ")")? ":" suite
  | "match" star_tests ":" NEWLINE INDENT case+ DEDENT
elifs: ("elif" named ":" suite)+
otherwise: "else" ":" suite
finally: "finally" ":" suite
excepts: except+
except: "except" ":" suite | "except" "*"? tests ("as" name)? ":" suite
withitems: withitem | withitems "," withitem
withitem: test | test "as" chain
withas: test "as" chain
case: "case" star_tests ("as" name)? ("if" named)? ":" suite
decorator: "@" named NEWLINE
suite: simple | NEWLINE INDENT statement+ DEDENT
typeparams: "[" typeparam ("," typeparam)* ","? "]"
typeparam: "*" name | "**" name | name (":" test)? ("=" test)?
params: param | params "," | params "," param
param: name (":" test)? ("=" test)? | "*" | "*" name (":" star_test)? | "**" name (":" test)? | "/"
lparams: lparam | lparams "," | lparams "," lparam
lparam: name ("=" test)? | "*" | "*" name | "**" name | "/"
named: test | name ":=" test
tests: star_tests
star_tests: star_test | star_tests "," star_test | star_tests ","
star_test: test | "*" chain
test: chain | chain "if" chain "else" test | "lambda" lparams? ":" test
chain: operand | chain binary operand
binary: "BINOP" | "ADDOP" | "*" | "**" | "/" | "@" | "in" | "not" "in" | "is" | "is" "not"
operand: primary | "ADDOP" operand | "~" operand | "not" operand | "await" operand
primary: atom | primary "." name | primary "(" args? ")" | primary "[" subscripts "]"
atom: name | NUMBER | strings | "..." | "(" ")" | "(" inside ")" | "[" "]" | "[" inside "]" | "{" "}" | "{" inside "}" | "{" pairs "}" | "(" yielded ")"
strings: STRING+
inside: item | inside "," item | inside "," | item comprehension
item: named | "*" chain
pairs: pair | pairs "," pair | pairs "," | pair comprehension
pair: test ":" test | "**" chain
comprehension: clause+
clause: "async"? "for" star_tests_c "in" chain | "if" cond
cond: chain | name ":=" chain | "lambda" lparams? ":" chain
star_tests_c: star_chain | star_tests_c "," star_chain | star_tests_c ","
star_chain: chain | "*" chain
subscripts: subscript | subscripts "," subscript | subscripts ","
subscript: named | "*" chain | test? ":" test? (":" test?)?
args: arg | args "," arg | args ","
arg: named | named comprehension | name "=" test | "*" test | "**" test
name: NAME | "match" | "case" | "type"
"""

_JS_COMMON = r"""
%shift else catch finally
program: item*
item: statement
block: "{" statement* "}"
statement: block | ";" | declaration | "if" "(" exprs ")" statement | "if" "(" exprs ")" statement "else" statement
  | "for" "await"? "(" for_head ")" statement | "while" "(" exprs ")" statement
  | "do" statement "while" "(" exprs ")" ";" | "do" statement "while" "(" exprs ")"
  | "return" exprs? ";" | "break" name? ";" | "continue" name? ";" | "throw" exprs ";" | "debugger" ";"
  | "try" block catch | "try" block catch "finally" block | "try" block "finally" block
  | "switch" "(" exprs ")" "{" case* "}" | name ":" statement | sexprs ";"
catch: "catch" block | "catch" "(" binding ")" block
case: "case" exprs ":" statement* | "default" ":" statement*
for_head: (varkind vars | exprs)? ";" exprs? ";" exprs? | varkind binding ("of" | "in") exprs | operand "in" exprs | chain "of" exprs
vars: var | vars "," var
varkind: "var" | "const" | "let"
name: NAME | "of" | "async" | "get" | "set" | "static" | "from" | "as" NAMES_TS
member_name: name | KEYWORDS
pattern: "{" props? "}" | "[" elements? "]"
exprs: expr | exprs "," expr
sexprs: sexpr | sexprs "," expr
expr: chain | "yield" | "yield" expr | "yield" "*" expr
sexpr: schain | "yield" | "yield" expr | "yield" "*" expr
chain: operand | chain binary operand | chain "?" expr ":" expr | arrow
schain: soperand | schain binary operand | schain "?" expr ":" expr | arrow
binary: "BINOP" | "ADDOP" | "*" | "=" | "<" | ">" | "in" | "instanceof"
operand: primary | prefix operand | primary "INCR"
soperand: sprimary | prefix operand | sprimary "INCR"
prefix: "!" | "~" | "ADDOP" | "INCR" | "typeof" | "void" | "delete" | "await"
primary: satom | object | function | class | primary_tail
primary_tail: primary "." member_name | primary "." PRIVATE | primary "?." member_name | primary "?." "(" args? ")" | primary "?." "[" exprs "]" | primary "(" args? ")" | primary "[" exprs "]" | primary TEMPLATE
sprimary: satom | sprimary "." member_name | sprimary "." PRIVATE | sprimary "?." member_name | sprimary "?." "(" args? ")" | sprimary "?." "[" exprs "]" | sprimary "(" args? ")" | sprimary "[" exprs "]" | sprimary TEMPLATE
satom: name | NUMBER | STRING | TEMPLATE | REGEX | PRIVATE | "this" | "super" | "null" | "true" | "false" | "new" "." name | "import" "(" args ")" | "import" "." name | "[" elements? "]" | paren | newexpr
newexpr: "new" newtarget "(" args? ")" | "new" newtarget
newtarget: name | "this" | "(" exprs ")" | newtarget "." member_name | newtarget "[" exprs "]" | function | class | "new" newtarget "(" args? ")"
args: arg | args "," arg | args ","
arg: expr | "..." expr
elements: element | "," | elements "," | elements "," element
element: expr | "..." expr
object: "{" props? "}"
props: prop | props "," prop | props ","
"""

JAVASCRIPT = (
    _JS_COMMON.replace("NAMES_TS", "")
    + r"""
KEYWORDS_RULE
declaration: varkind vars ";" | function | class
  | "import" STRING ";" | "import" imports "from" STRING ";"
  | "export" "default" function | "export" "default" class | "export" "default" schain ";" | "export" "default" object ";"
  | "export" varkind vars ";" | "export" function | "export" class
  | "export" "{" specs? "}" ("from" STRING)? ";" | "export" "*" ("as" name)? "from" STRING ";"
imports: name | name "," "{" specs? "}" | name "," "*" "as" name | "{" specs? "}" | "*" "as" name
specs: spec | specs "," spec | specs ","
spec: member_name ("as" member_name)?
var: binding ("=" expr)?
binding: name | pattern
paren: "(" items ")"
items: exprs | exprs "," | exprs "," "..." binding
arrow: arrow_head "=>" block | arrow_head "=>" sexpr | arrow_head "=>" object | arrow_head "=>" function | arrow_head "=>" class
arrow_head: name | "async" name | "(" ")" | "(" "..." binding ")" | paren | "async" "(" ")" | "async" paren | "async" "(" "..." binding ")"
function: "async"? "function" "*"? name? "(" params? ")" block
params: param | params "," param | params ","
param: binding | binding "=" expr | "..." binding
class: "class" name? ("extends" primary)? "{" classmember* "}"
classmember: ";" | "static"? method | "static"? propname ("=" expr)? ";" | "static" block
method: methodmods? propname "(" params? ")" block
methodmods: "async" | "*" | "async" "*" | "get" | "set"
propname: member_name | STRING | NUMBER | "[" expr "]" | PRIVATE
prop: propname ":" expr | name | name "=" expr | "..." expr | method
"""
)

TYPESCRIPT = (
    _JS_COMMON.replace("NAMES_TS", '| "type" | "interface" | "declare" | "abstract" | "readonly" | "public" | "private" | "protected" | "implements" | "namespace" | "is" | "keyof" | "infer" | "asserts" | "override" | "satisfies" | "module"')
    + r"""
KEYWORDS_RULE
declaration: varkind vars ";" | function | decorator* class | interface | alias | enum | "declare" declaration | namespace | overload
  | "import" STRING ";" | "import" "type"? imports "from" STRING ";" | "import" name "=" exprs ";"
  | "export" "default" function | "export" "default" class | "export" "default" schain ";" | "export" "default" object ";" | "export" "default" interface
  | "export" "=" exprs ";" | "export" declaration
  | "export" "type"? "{" specs? "}" ("from" STRING)? ";" | "export" "*" ("as" name)? "from" STRING ";"
overload: "async"? "function" name signature ";"
imports: name | name "," "{" specs? "}" | name "," "*" "as" name | "{" specs? "}" | "*" "as" name
specs: spec | specs "," spec | specs ","
spec: "type"? member_name ("as" member_name)?
interface: "interface" name generics? ("extends" types)? typebody
alias: "type" name generics? "=" type ";"
enum: "const"? "enum" name "{" enums? "}"
enums: enumerator | enums "," enumerator | enums ","
enumerator: propname ("=" expr)?
namespace: ("namespace" | "module") (dotted | STRING) "{" statement* "}"
dotted: name | dotted "." name
var: binding "!"? annotation? ("=" expr)?
binding: name | pattern
annotation: ":" type | ":" "asserts" name ("is" type)? | ":" (name | "this") "is" type
paren: "(" items ")"
items: pitem | items "," pitem | items "," | items "," "..." binding annotation?
pitem: expr | chain annotation ("=" expr)? | name "?" annotation?
arrow: arrow_head "=>" (block | sexpr | object | function)
arrow_head: name | "async" name | "async"? generics? arrow_params annotation?
arrow_params: "(" ")" | "(" "..." binding annotation? ")" | paren
function: "async"? "function" "*"? name? signature block
params: param | params "," param | params ","
param: ptarget "?"? annotation? ("=" expr)? | "..." binding annotation?
ptarget: binding | "this" | access ptarget | decorator ptarget
access: "public" | "private" | "protected" | "readonly" | "override"
decorator: "@" dotted | "@" dotted "(" args? ")"
class: "abstract"? "class" name? generics? heritage? ("implements" types)? "{" classmember* "}"
heritage: "extends" newtarget typeargs? ("(" args? ")")?
classmember: ";" | method | propname ("?" | "!")? annotation? ("=" expr)? ";" | "static" block | indexer ";"
  | methodhead ";" | decorator classmember | modifier classmember
modifier: access | "static" | "abstract" | "declare"
indexer: "[" name ":" type "]" annotation
method: methodhead block
methodhead: methodmods? propname "?"? signature
signature: generics? "(" params? ")" annotation?
methodmods: "async" | "*" | "async" "*" | "get" | "set"
propname: member_name | STRING | NUMBER | "[" expr "]" | PRIVATE
prop: propname ":" expr | name | name "=" expr | "..." expr | method
generics: "<" generic ("," generic)* ","? ">"
generic: "const"? name ("extends" type)? ("=" type)?
types: type | types "," type
typeargs: "<" types ">"
type: union | union "extends" union "?" type ":" type | "(" params? ")" "=>" type | generics "(" params? ")" "=>" type | "new" "(" params? ")" "=>" type
union: "|"? postfix | union ("|" | "&") postfix
postfix: simpletype | postfix "[" "]" | postfix "[" type "]" | "keyof" postfix | "readonly" postfix | "typeof" dotted | "infer" name
simpletype: dotted typeargs? | "void" | "null" | "this" | "true" | "false" | STRING | "ADDOP"? NUMBER | TEMPLATE | typebody | "[" "]" | "[" tuple "]" | "(" type ")" | "import" "(" STRING ")"
tuple: titem | tuple "," titem | tuple ","
titem: type | "..." type | name "?"? ":" type | type "?"
typebody: "{" "}" | "{" tmembers "}"
tmembers: tmember | tmembers tsep | tmembers tsep tmember
tsep: ";" | ","
tmember: "readonly"? propname "?"? annotation? | methodhead | "readonly"? indexer | "new"? signature
  | "[" name "in" type ("as" type)? "]" "?"? annotation
"""
).replace(
    'primary_tail: primary "." member_name', 'primary_tail: primary "!" | primary typeargs "(" args? ")" | primary "." member_name'
).replace(
    'sprimary: satom | sprimary "." member_name', 'sprimary: satom | sprimary "!" | sprimary typeargs "(" args? ")" | sprimary "." member_name'
).replace(
    "chain: operand | chain binary operand |", 'chain: operand | chain ("as" | "satisfies") type | chain "as" "const" | chain binary operand |'
).replace(
    "schain: soperand | schain binary operand |", 'schain: soperand | schain ("as" | "satisfies") type | schain "as" "const" | schain binary operand |'
).replace(
    'newexpr: "new" newtarget "(" args? ")"', 'newexpr: "new" newtarget typeargs? "(" args? ")"'
).replace(
    'binary: "BINOP"', 'binary: "|" | "&" | ">" ">" | ">" ">" ">" | ">" ">" "=" | ">" ">" ">" "=" | "BINOP"'
)

_WORDS = "var const let if else for while do return break continue throw debugger try catch finally switch case default in instanceof new this super null true false typeof void delete await yield function class extends import export enum".split()
JAVASCRIPT = JAVASCRIPT.replace("KEYWORDS_RULE\n", "").replace("| KEYWORDS", "| " + " | ".join(f'"{w}"' for w in _WORDS))
TYPESCRIPT = TYPESCRIPT.replace("KEYWORDS_RULE\n", "").replace("| KEYWORDS", "| " + " | ".join(f'"{w}"' for w in _WORDS))

JAVA = r"""
%shift else catch finally
unit: package? import* typedecl*
package: annotation* "package" qname ";"
import: "import" "static"? qname ("." "*")? ";" | ";"
typedecl: modifier* class | modifier* interface | modifier* enum | modifier* record | modifier* annotype | ";"
modifier: "MODIFIER" | "static" | "final" | "default" | "synchronized" | "sealed" | "non" "ADDOP" "sealed" | annotation
annotation: "@" qname | "@" qname "(" ")" | "@" qname "(" annargs ")"
annargs: annarg | annargs "," annarg
annarg: expr | annarray | annotation | name "=" annarray | name "=" annotation
annarray: "{" "}" | "{" annargs ","? "}"
qname: name | qname "." name
name: NAME | "record" | "sealed" | "permits" | "yield" | "var" | "non"
class: "class" name typeparams? ("extends" type)? ("implements" types)? ("permits" types)? body
interface: "interface" name typeparams? ("extends" types)? ("permits" types)? body
record: "record" name typeparams? "(" params? ")" ("implements" types)? body
enum: "enum" name ("implements" types)? "{" constants? ","? (";" member*)? "}"
annotype: "@" "interface" name body
constants: constant | constants "," constant
constant: annotation* name ("(" args? ")")? body?
body: "{" member* "}"
member: typedecl | "static"? block | modifier* typeparams? type name "(" params? ")" dims? throws? (block | ";" | "default" elementvalue ";")
  | modifier* typeparams? "void" name "(" params? ")" throws? (block | ";")
  | modifier* typeparams? name "(" params? ")" throws? block | modifier* name block | modifier* type vars ";"
elementvalue: expr | annarray | annotation
throws: "throws" types
params: param | params "," param
param: modifier* type "..."? name dims? | modifier* type "this"
typeparams: "<" typeparam ("," typeparam)* ">"
typeparam: annotation* name ("extends" bound)?
bound: type | bound "&" type
types: type | types "," type
type: simple dims? | "PRIMITIVE" dims?
simple: qname | qname typeargs | simple_g "." name | simple_g "." name typeargs
simple_g: qname typeargs | simple_g "." name typeargs
typeargs: "<" ">" | "<" typearg ("," typearg)* ">"
typearg: type | "?" | "?" "extends" type | "?" "super" type
dims: ("[" "]")+
vars: var | vars "," var
var: name dims? ("=" init)?
init: expr | arrayinit
arrayinit: "{" "}" | "{" "," "}" | "{" inits ","? "}"
inits: init | inits "," init
block: "{" statement* "}"
statement: block | ";" | localvar ";" | typedecl_local | "if" "(" expr ")" statement | "if" "(" expr ")" statement "else" statement
  | "for" "(" forinit? ";" expr? ";" exprs? ")" statement | "for" "(" modifier* type name ":" expr ")" statement
  | "while" "(" expr ")" statement | "do" statement "while" "(" expr ")" ";" | "return" expr? ";" | "throw" expr ";"
  | "break" name? ";" | "continue" name? ";" | "yield" expr ";" | "assert" expr (":" expr)? ";" | "synchronized" "(" expr ")" block
  | "try" block catches ("finally" block)? | "try" block "finally" block | "try" "(" resources ";"? ")" block catches? ("finally" block)?
  | switch | name ":" statement | statement_expr ";"
statement_expr: expr
typedecl_local: modifier* class | modifier* enum | modifier* interface | modifier* record
localvar: ("final" | annotation)* type vars
forinit: localvar | exprs
exprs: expr | exprs "," expr
catches: catch+
catch: "catch" "(" modifier* union name ")" block
union: type | union "|" type
resources: resource | resources ";" resource
resource: modifier* type name "=" expr | expr
switch: "switch" "(" expr ")" "{" case* "}"
case: label ":" statement* | label "->" (expr ";" | block | "throw" expr ";")
label: "case" labels ("when" expr)? | "default"
labels: labelitem | labels "," labelitem
labelitem: expr | type name | "default"
expr: chain | lambda
chain: operand | chain binary operand | chain "?" expr ":" expr | chain "instanceof" "final"? type name? | chain binary lambda
binary: "BINOP" | "ADDOP" | "*" | "=" | "<" | ">" | ">" ">" | ">" ">" ">" | "&" | "|"
lambda: name "->" lambody | "(" ")" "->" lambody | "(" names ")" "->" lambody | "(" params ")" "->" lambody
names: name "," name | names "," name
lambody: expr | block
operand: primary | "ADDOP" operand | "INCR" operand | "!" operand | "~" operand | primary "INCR" | cast | switch
cast: "(" "PRIMITIVE" dims? ")" operand | "(" simple dims? bounds? ")" castable | "(" simple dims? ")" lambda
bounds: ("&" type)+
castable: primary | "!" operand | "~" operand | cast | primary "INCR" | switch
primary: qname | NUMBER | STRING | "this" | "super" | "null" | "true" | "false" | "(" expr ")" | primary_n "." name | access | call | new | primary_n "." "new" newbody | type ".class" | "void" ".class" | primary "::" (name | "new") | simple_g "::" (name | "new") | "PRIMITIVE" dims "::" "new" | qname dims "::" "new" | qname "." "this" | qname "." "super"
primary_n: NUMBER | STRING | "this" | "super" | "null" | "true" | "false" | "(" expr ")" | primary_n "." name | access | call | new | type ".class" | qname "." "this" | qname "." "super"
access: qname "[" expr "]" | primary_n "[" expr "]"
call: qname "(" args? ")" | primary_n "." typeargs? name "(" args? ")" | qname "." typeargs name "(" args? ")" | "this" "(" args? ")" | "super" "(" args? ")"
args: expr | args "," expr
new: "new" newbody
newbody: annotation* simple "(" args? ")" body? | (simple | "PRIMITIVE") dimexprs dims? | (simple | "PRIMITIVE") dims arrayinit
dimexprs: ("[" expr "]")+
"""

C = r"""
%shift else
unit: external*
external: specs declarator block | specs initdecls ";" | specs ";" | ";" | "ASSERT" "(" args ")" ";" | "extern" STRING "{" external* "}" | "extern" STRING external
specs: spec | specs spec
spec: "TYPE" | "QUALIFIER" | "STORAGE" | "extern" | NAME | tag | "ATTRIBUTE" "(" args? ")" | "ATTRIBUTE"
tag: ("struct" | "union") NAME? "{" field* "}" | ("struct" | "union") NAME | "enum" NAME? "{" enumerators ","? "}" | "enum" NAME
field: specs fields? ";" | ";"
fields: fielddecl | fields "," fielddecl
fielddecl: declarator | declarator? ":" expr
enumerators: enumerator | enumerators "," enumerator
enumerator: NAME ("=" expr)?
initdecls: initdecl | initdecls "," initdecl
initdecl: declarator ("=" initializer)?
initializer: expr | "{" "}" | "{" inits ","? "}"
inits: init | inits "," init
init: initializer | designators "=" initializer
designators: ("." NAME | "[" expr "]")+
declarator: pointer? direct ("ATTRIBUTE" "(" args? ")")?
pointer: ("*" "QUALIFIER"*)+
direct: NAME | "(" declarator ")" | direct "(" params? ")" | direct "[" "QUALIFIER"* "STORAGE"? expr? "]"
params: param | params "," param | params "," "..."
param: specs declarator | specs abstract?
abstract: pointer | pointer? dabstract
dabstract: "(" abstract ")" | dabstract "(" params? ")" | "(" params? ")" | dabstract "[" expr? "]" | "[" expr? "]"
block: "{" blockitem* "}"
blockitem: statement | localdecl
localdecl: specs initdecls ";" | specs ";"
statement: block | ";" | exprs ";" | "if" "(" exprs ")" statement | "if" "(" exprs ")" statement "else" statement
  | "while" "(" exprs ")" statement | "do" statement "while" "(" exprs ")" ";" | "for" "(" (exprs? ";" | localdecl) exprs? ";" exprs? ")" statement
  | "switch" "(" exprs ")" statement | "case" expr ":" blockitem | "case" expr "..." expr ":" blockitem | "default" ":" blockitem | "case" expr ":" | "default" ":"
  | NAME ":" statement | "goto" NAME ";" | "break" ";" | "continue" ";" | "return" exprs? ";" | "ASSERT" "(" args ")" ";"
exprs: expr | exprs "," expr
expr: operand | expr binary operand | expr "?" exprs? ":" operand
binary: "BINOP" | "ADDOP" | "*" | "&" | "="
operand: postfix | unary operand | "(" typename ")" operand | "sizeof" operand | "sizeof" "(" typename ")"
unary: "ADDOP" | "*" | "&" | "!" | "~" | "INCR"
typename: specs_t abstract?
specs_t: spec_t | specs_t spec_t
spec_t: "TYPE" | "QUALIFIER" | NAME | ("struct" | "union" | "enum") NAME
postfix: "(" typename ")" "{" inits ","? "}" | NAME | NUMBER | strings | "(" exprs ")" | postfix "(" args? ")" | postfix "[" exprs "]" | postfix "." NAME | postfix "ARROW" NAME | postfix "INCR"
strings: strpart+
strpart: STRING | NAME STRING
args: arg | args "," arg
arg: expr | typename_kw
typename_kw: "TYPE" abstract? | ("struct" | "union" | "enum") NAME abstract?
"""

GO = r"""
%shift else
file: package importdecl* topdecl*
package: "package" NAME ";"
importdecl: "import" importspec ";" | "import" "(" importspecs? ")" ";"
importspecs: importspec ";"? | importspec ";" importspecs
importspec: (NAME | ".")? STRING
topdecl: decl ";" | func ";"
decl: "const" constspec | "const" "(" constspecs? ")" | "var" varspec | "var" "(" varspecs? ")" | "type" typespec | "type" "(" typespecs? ")"
constspecs: constspec ";"? | constspec ";" constspecs
varspecs: varspec ";"? | varspec ";" varspecs
typespecs: typespec ";"? | typespec ";" typespecs
constspec: names | names type? "=" exprs
varspec: names type | names type? "=" exprs
typespec: NAME typeparams? "="? type
typeparams: "[" tparam ("," tparam)* ","? "]"
tparam: names constraint
constraint: cterm | constraint "|" cterm
cterm: "~"? type
names: NAME | names "," NAME
func: "func" receiver? NAME typeparams? signature block?
receiver: "(" params? ")"
signature: "(" params? ")" result?
result: type | "(" params ")"
params: paramlist ","?
paramlist: param | paramlist "," param
param: type | NAME type | "..." type | NAME "..." type
type: tname | "*" type | "[" "]" type | "[" expr "]" type | "[" "..." "]" type | "map" "[" type "]" type | chantype | "func" signature | struct | interface | "(" type ")"
tname: NAME | NAME "." NAME | NAME "[" types "]" | NAME "." NAME "[" types "]"
types: type | types "," type
chantype: "chan" type | "chan" "<-" type | "<-" "chan" type
struct: "struct" "{" fields? "}"
fields: field ";"? | field ";" fields
field: names type STRING? | "*"? tname STRING?
interface: "interface" "{" imembers? "}"
imembers: imember ";"? | imember ";" imembers
imember: NAME signature | constraint
block: "{" statements? "}"
statements: statement | terminated | terminated statement
terminated: statement? ";" | terminated statement? ";"
statement: decl | simple | labeled | "go" expr | "defer" expr | "return" exprs? | "break" NAME? | "continue" NAME? | "goto" NAME | "fallthrough" | block | if | switch | select | for
labeled: NAME ":" statement?
simple: exprs | exprs "ASSIGN" exprs | exprs "=" exprs | exprs ":=" exprs | expr "INCR" | expr "<-" expr
if: "if" (simple? ";")? expr block | "if" (simple? ";")? expr block "else" (if | block)
switch: "switch" (simple? ";")? simple? "{" clause* "}"
clause: "case" exprtypes ":" statements? | "default" ":" statements?
exprtypes: exprtype | exprtypes "," exprtype
exprtype: expr | type_only
type_only: "*" type_only | "[" "]" type | "map" "[" type "]" type | "func" signature | interface | struct | chantype
select: "select" "{" comm* "}"
comm: "case" simple ":" statements? | "default" ":" statements?
for: "for" block | "for" expr block | "for" simple? ";" expr? ";" simple? block | "for" rangeclause block
rangeclause: (exprs ("=" | ":="))? "range" expr
exprs: expr | exprs "," expr
expr: unary | expr binary unary
binary: "BINOP" | "ADDOP" | "*" | "|" | "&" | "^"
unary: primary | ("ADDOP" | "!" | "^" | "*" | "&" | "<-" | "~") unary
primary: operand | primary "." NAME | primary "." "(" type ")" | primary "." "(" "type" ")" | primary "[" index "]" | primary "(" args? ")" | literal
operand: NAME | NUMBER | STRING | "(" expr ")" | "(" type_only ")" | "func" signature block
literal: littype litvalue | convtype "(" expr ","? ")"
littype: "[" "]" type | "[" expr "]" type | "[" "..." "]" type | "map" "[" type "]" type | struct | NAME | NAME "." NAME | NAME "[" types "]"
convtype: "[" "]" type | "map" "[" type "]" type | interface | chantype | "func" signature | struct
litvalue: "{" "}" | "{" elements ","? "}"
elements: element | elements "," element
element: value | value ":" value
value: expr | litvalue
index: expr | types_i | expr? ":" expr? | expr? ":" expr ":" expr
types_i: type_only | expr "," index_rest
index_rest: expr | type_only | expr "," index_rest
args: arg | args "," arg | args "," | args "..." | args "..." ","
arg: expr | type_only
"""
