"""Grammars by language, in the notation of :mod:`gll`. Dialects are the rules to start from."""

from __future__ import annotations

from functools import lru_cache

from lakeseek.llm.syntax.gll import Grammar

_CLASSES = {"ID": "I", "NUM": "N", "STR": "S", "TPL": "T", "REX": "R", "CHR": "C", "NL": "\n", "LIFE": "L", "WORD": "W", "OP": "O"}

JS = r"""
%seq Module ';' NL
%seq Script ';' NL
%seq Stmts ';' NL
%seq Members ';' NL B
Module: ModItem*
Script: Stmt*
Template: Expr
Stmts: Stmt*
Semi: ';' | NL | END
Stmt: ';' | NL | B[Stmts] | VarKind Vars Semi | Function | Class | ID ':' NL? Stmt
  | 'if' P[Expr] NL? Stmt Else? | 'for' 'await'? P[ForHead] NL? Stmt | 'while' P[Expr] NL? Stmt | 'do' NL? Stmt NL? 'while' P[Expr]
  | 'return' Expr? Semi | 'break' ID? Semi | 'continue' ID? Semi | 'throw' Expr Semi | 'debugger' Semi
  | 'try' B[Stmts] Catch? Finally? | 'switch' P[Expr] B[Cases] | 'with' P[Expr] Stmt | Expr Semi
  | Decorators Class
ModItem: Stmt | 'import' STR ImportWith? Semi | 'import' ImportClause 'from' STR ImportWith? Semi
  | 'export' 'default' (Function | Class | Assign Semi) | 'export' (VarKind Vars Semi | Function | Class)
  | 'export' B[Specs] ('from' STR ImportWith?)? Semi | 'export' '*' ('as' (NAME | STR))? 'from' STR ImportWith? Semi | Decorators 'export' 'default'? Class
Else: NL? 'else' NL? Stmt
Catch: NL? 'catch' P[CatchParam]? B[Stmts]
CatchParam: Binding
Finally: NL? 'finally' B[Stmts]
Cases: (NL | Case)*
Case: ('case' Expr | 'default') ':' Stmts
ImportWith: ('with' | 'assert') B[Props]
ImportClause: ID (',' (B[Specs] | '*' 'as' ID))? | B[Specs] | '*' 'as' ID
Specs: (Spec (',' Spec)* ','?)?
Spec: (NAME | STR) ('as' (NAME | STR))?
VarKind: 'var' | 'let' | 'const' | 'using'
Vars: Var (',' Var)*
Var: Binding ('=' Assign)?
ForHead: ForInit? ';' Expr? ';' Expr? | VarKind? Postfix 'of' Assign | VarKind? Binding ('of' | 'in') Expr | Postfix 'in' Expr
ForInit: VarKind Vars | Expr
Binding: ID | S[BindElems] | B[BindProps]
BindElems: (','* BindElem (','+ BindElem)*)? ','*
BindElem: '...'? Binding ('=' Assign)?
BindProps: (BindProp (',' BindProp)* ','?)?
BindProp: '...' ID | ID ('=' Assign)? | PropName ':' Binding ('=' Assign)?
Function: 'async'? 'function' '*'? NAME? P[Params] B[Stmts]
Params: (Param (',' Param)* ','?)?
Param: '...'? Binding ('=' Assign)?
Class: 'class' ID? ('extends' Postfix)? B[Members]
Members: Member*
Member: ';' | NL | Decorators? Mod* '*'? PropName P[Params] B[Stmts] | Decorators? Mod* PropName ('=' Assign)? Semi | 'static' B[Stmts]
Mod: 'static' | 'async' | 'get' | 'set' | 'accessor'
Decorators: ('@' Postfix NL?)+
PropName: NAME | STR | NUM | S[Assign] | '#' NAME
Expr: Assign (',' Assign)*
Assign: Arrow | 'yield' '*'? Assign? | Unary (Binary Unary)* Tail?
Tail: '?' Assign ':' Assign | AssignOp Assign
AssignOp: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '=' | '>' '>' '>' '=' | '&&=' | '||=' | '??='
Binary: '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '!==' | '<' | '>' '='? | '<=' | '>' '>' '>'? | '<<' | '&' | '|' | '^' | '&&' | '||' | '??' | 'in' | 'instanceof'
Unary: Prefix* Postfix ('++' | '--')?
Prefix: '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await'
Postfix: Primary Suffix*
Suffix: '.' '#'? NAME | '?.' ('#'? NAME | P[Args] | S[Expr]) | P[Args] | S[Expr] | TPL
Args: (Arg (',' Arg)* ','?)?
Arg: '...'? Assign
Primary: ID | NUM | STR | TPL | REX | 'this' | 'super' | 'null' | 'true' | 'false' | P[Expr] | S[Elems] | B[Props] | Function | Class
  | 'new' New | 'import' P[Args] | 'import' '.' NAME | '#' NAME
New: 'new' New | '.' NAME | Primary NewSuffix* P[Args]?
NewSuffix: '.' '#'? NAME | S[Expr] | TPL
Arrow: 'async'? (ID | P[Params]) '=>' (B[Stmts] | Assign)
Elems: ','* (Arg (','+ Arg)* ','*)?
Props: (Prop (',' Prop)* ','?)?
Prop: '...' Assign | PropName ':' Assign | ID ('=' Assign)? | Mod* '*'? PropName P[Params] B[Stmts]
"""
JS_SOFT = "of async get set static from as type accessor using assert let yield await"

TS = JS + r"""
ModItem |= 'import' 'type' ImportClause 'from' STR ImportWith? Semi | 'export' 'type' B[Specs] ('from' STR ImportWith?)? Semi | 'export' 'type' '*' ('as' NAME)? 'from' STR ImportWith? Semi
Spec |= 'type' (NAME | STR) ('as' (NAME | STR))?
Stmt |= 'export' (VarKind Vars Semi | Function | Class) | 'export'? 'declare'? 'type' ID TParams? '=' NL? Type Semi | 'export'? 'default'? 'declare'? 'interface' ID TParams? ('extends' TypeList)? B[TMembers]
  | 'export'? 'declare'? 'const'? 'enum' ID B[Enums] | 'export'? 'declare'? ('namespace' | 'module') (ID ('.' ID)* | STR) B[Module]? Semi?
  | 'export'? 'declare' (VarKind Vars Semi | Function | Class | 'global' B[Stmts]) | 'export'? 'default'? 'declare'? 'abstract' Class | Decorators 'export'? 'default'? 'abstract' Class
  | 'import' 'type'? ID '=' ('require' P[Args] | ID ('.' ID)*) Semi | 'export' '=' Expr Semi | 'export' 'as' 'namespace' ID Semi
  | 'export'? 'default'? 'declare'? 'async'? 'function' '*'? ID TParams? P[Params] Ret? Semi
Var |= Binding '!'? ':' Type ('=' Assign)?
CatchParam |= Binding ':' Type
Function |= 'async'? 'function' '*'? ID? TParams? P[Params] Ret? B[Stmts]
Ret: ':' ('asserts' (ID | 'this') ('is' Type)? | (ID | 'this') 'is' Type | Type)
Param |= Decorators? PMod* '...'? (Binding | 'this') '?'? (':' Type)? ('=' Assign)?
PMod: 'public' | 'private' | 'protected' | 'readonly' | 'override'
Class |= 'class' ID? TParams? ('extends' Postfix Targs?)? ('implements' TypeList)? B[Members]
Member |= Decorators? Mod* '*'? PropName '?'? TParams? P[Params] Ret? (B[Stmts] | Semi) | Decorators? Mod* PropName ('?' | '!')? (':' Type)? ('=' Assign)? Semi
  | Mod* S[Index] ':' Type Semi
Mod |= PMod | 'abstract' | 'declare'
Tail |= 'as' Type Tail? | 'satisfies' Type Tail?
Binary |= 'as' Type Binary | 'satisfies' Type Binary | '!' Binary | 'as' 'const' Binary
Suffix |= '!' | Targs P[Args] | Targs TPL
Prefix |= Targs
Unary |= Prefix* Postfix '!' ('++' | '--')?
NewSuffix |= Targs | '!'
Arrow |= 'async'? TParams? P[Params] Ret? '=>' (B[Stmts] | Assign)
Tail |= 'as' 'const' Tail?
Prop |= Mod* '*'? PropName TParams? P[Params] Ret? B[Stmts]
TParams: '<' TParam (',' TParam)* ','? '>'
TParam: ('const' | 'in' | 'out')* ID ('extends' Type)? ('=' Type)?
Targs: '<' Type (',' Type)* '>'
TypeList: Type (',' Type)*
Type: TParams? P[Params] '=>' TRet | 'abstract'? 'new' TParams? P[Params] '=>' Type | TUnion TCond?
TRet: Type | ID 'is' Type | 'asserts' ID ('is' Type)?
TCond: 'extends' TUnion '?' Type ':' Type
TUnion: ('|' | '&')? TPost (('|' | '&') TPost)*
TPost: TPrim (S[TIndex])*
TIndex: Type?
TPrim: NAME ('.' NAME)* Targs? | STR | NUM | '-' NUM | TPL | 'void' | 'null' | 'this' | 'true' | 'false' | B[TMembers] | S[TElems] | P[Type]
  | 'typeof' Postfix Targs? | ('keyof' | 'readonly' | 'unique' | 'infer') TPost | 'import' P[Args] ('.' NAME)* Targs? | B[Mapped]
TElems: (TElem (',' TElem)* ','?)?
TElem: '...'? (NAME '?'? ':')? Type '?'?
TMembers: (TMember | ';' | ',' | NL)*
TMember: ('readonly' | 'get' | 'set')* PropName '?'? (TParams? P[Params] Ret? | (':' Type)?) TEnd | 'new'? TParams? P[Params] Ret? TEnd | ('readonly' | '-' | '+')* S[Index] ':' Type TEnd
TEnd: ';' | ',' | NL | END
Index: ID ':' Type
Mapped: (('+' | '-')? 'readonly')? S[MapKey] (('+' | '-')? '?')? (':' Type)? ';'? NL?
MapKey: ID 'in' Type ('as' Type)?
Enums: (Enum (',' Enum)* ','?)?
Enum: (NAME | STR) ('=' Assign)?
"""
TS_SOFT = JS_SOFT + (" declare interface abstract namespace module enum readonly public private protected override implements asserts is"
                     " keyof infer unique satisfies require global out")

GO = r"""
%seq Tops ';'
%seq Stmts ';'
File: ';'* 'package' ID ';' Tops
Tops: (Top | ';')*
Top: 'import' (Import | P[Imports]) ';' | Decl ';' | 'func' P[Params]? ID TParams? Sig B[Stmts]? ';'
TParams: S[TPs]
TPs: TP (',' TP)* ','?
TP: ID (',' ID)* Constraint
Constraint: '~'? Type ('|' '~'? Type)*
Imports: (Import (';' Import)* ';'?)? ';'*
Import: (ID | '.')? STR
Decl: 'const' (Const | P[Consts]) | 'var' (Var | P[Vars]) | 'type' (TypeDef | P[TypeDefs])
Consts: (Const (';' Const)*)? ';'*
Const: Ids Type? ('=' Exprs)?
Vars: (Var (';' Var)*)? ';'*
Var: Ids (Type ('=' Exprs)? | '=' Exprs)
TypeDefs: (TypeDef (';' TypeDef)*)? ';'*
TypeDef: ID TParams? '='? Type
Ids: ID (',' ID)*
Sig: P[Params] Result?
Result: Type | P[Params]
Params: (Param (',' Param)* ','?)? ';'?
Param: ID? '...'? Type
Type: ID ('.' ID)? S[Targs]? | '*' Type | S[ArrLen] Type | 'map' S[Type] Type | 'chan' '<-'? Type | '<-' 'chan' Type | 'func' Sig | 'struct' B[Fields] | 'interface' B[Meths] | P[Type]
ArrLen: (Expr | '...')?
Targs: Type (',' Type)* ','?
Fields: (Field (';' Field)*)? ';'*
Field: Ids Type STR? | '*'? ID ('.' ID)? S[Targs]? STR?
Meths: (Meth (';' Meth)*)? ';'*
Meth: ID Sig | Constraint
Stmts: (Stmt | ';')*
Stmt: Simple End | Decl End | 'return' Exprs? End | 'break' ID? End | 'continue' ID? End | 'goto' ID End | 'fallthrough' End | 'defer' Expr End | 'go' Expr End
  | B[Stmts] End | If End | 'switch' Head? B[Cases] End | 'select' B[Cases] End | 'for' ForHead? B[Stmts] End | ID ':' Stmt | ID ':' END
End: ';' | END
If: 'if' Head B[Stmts] ('else' (If | B[Stmts]))?
Head: (Simple? ';')? Simple?
ForHead: Simple? ';' Simple? ';' Simple? | Simple | (Exprs (':=' | '='))? 'range' Expr
Cases: Case*
Case: ('case' (CaseItem (',' CaseItem)*) | 'default') ':' Stmts
CaseItem: Type | Expr | Simple
Simple: Exprs | Exprs (':=' | AssignOp) Exprs | Expr ('++' | '--') | Expr '<-' Expr | ID ':=' Expr '.' P[TypeWord]
TypeWord: 'type'
AssignOp: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
Exprs: Expr (',' Expr)*
Expr: Unary (Bin Unary)*
Bin: '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>>' | '&^' | '&&' | '||' | '==' | '!=' | '<' | '<=' | '>' | '>='
Unary: ('+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~')* Postfix
Postfix: Prim Suf*
Suf: '.' ID | '.' P[TypeOr] | P[Args] | S[Index] | B[Elems]
TypeOr: Type | 'type'
Args: (Arg (',' Arg)* ','?)? '...'? ','? ';'?
Arg: Expr '...'? | Type
Index: (Expr | Type) (',' Type)* ','? | Expr? ':' Expr? (':' Expr)?
Prim: ID | NUM | STR | CHR | P[Expr] | P[Type] | 'func' Sig B[Stmts] | LitType B[Elems] | Type P[Args]
LitType: S[ArrLen] Type | 'map' S[Type] Type | 'struct' B[Fields]
Elems: (Elem (',' Elem)* ','?)? ';'?
Elem: (Value ':')? Value
Value: Expr | B[Elems]
"""

JAVA = r"""
%seq Stmts ';'
%seq Members ';' B
Unit: Annots? ('package' Qual ';')? (Import | ';')* (TypeDecl | ';')*
Compact: (Import | ';')* Member+
Import: 'import' 'static'? Qual ('.' '*')? ';' | 'import' 'module' Qual ';'
Qual: ID ('.' ID)*
TypeDecl: Mod* ('class' ID TParams? ('extends' Type)? ('implements' Types)? ('permits' Types)? B[Members] | 'interface' ID TParams? ('extends' Types)? ('permits' Types)? B[Members]
  | 'enum' ID ('implements' Types)? B[Enum] | '@' 'interface' ID B[Members] | 'record' ID TParams? P[Params] ('implements' Types)? B[Members])
Mod: 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non-sealed' | Annot
Annots: Annot+
Annot: '@' Qual P[AnnotArgs]?
AnnotArgs: (ID '=' AnnotVal (',' ID '=' AnnotVal)* | AnnotVal)?
AnnotVal: Expr | B[AnnotVals] | Annot
AnnotVals: (AnnotVal (',' AnnotVal)* ','?)?
Members: Member*
Member: ';' | TypeDecl | 'static'? B[Stmts] | Mod* TParams? Annot* (Type | 'void') ID P[Params] Dims Throws? (B[Stmts] | ('default' AnnotVal)? ';') | Mod* TParams? ID P[Params] Throws? B[Stmts]
  | Mod* ID B[Stmts] | Mod* Type Vars ';'
Throws: 'throws' Types
Types: Type (',' Type)*
Enum: (EnumConst (',' EnumConst)*)? ','? (';' Members)?
EnumConst: Annot* ID P[Args]? B[Members]?
TParams: '<' TParam (',' TParam)* '>'
TParam: Annot* ID ('extends' Type ('&' Type)*)?
Type: Annot* (Prim | ID Targs? ('.' Annot* ID Targs?)*) Dims
Dims: (Annot* S[Empty])*
Empty: 
Prim: 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double'
Targs: '<' (Targ (',' Targ)*)? '>'
Targ: Annot* '?' (('extends' | 'super') Type)? | Type
Params: (Param (',' Param)*)?
Param: Mod* Type Annot* '...'? (ID '.')* (ID | 'this') Dims
Vars: Var (',' Var)*
Var: ID Dims ('=' Init)?
Init: Expr | B[Inits]
Inits: (Init (',' Init)* ','?)?
Stmts: Stmt*
Stmt: ';' | B[Stmts] | Mod* Type Vars ';' | TypeDecl | Expr ';' | 'if' P[Expr] Stmt ('else' Stmt)? | 'while' P[Expr] Stmt | 'do' Stmt 'while' P[Expr] ';' | 'for' P[ForHead] Stmt
  | 'return' Expr? ';' | 'break' ID? ';' | 'continue' ID? ';' | 'throw' Expr ';' | 'yield' Expr ';' | 'try' P[Resources]? B[Stmts] Catch* ('finally' B[Stmts])? | SwitchStmt
  | 'synchronized' P[Expr] B[Stmts] | 'assert' Expr (':' Expr)? ';' | ID ':' Stmt
Catch: 'catch' P[CatchParam] B[Stmts]
CatchParam: Mod* Type ('|' Type)* ID
Resources: Resource (';' Resource)* ';'?
Resource: Mod* Type ID '=' Expr | Expr
ForHead: (Mod* Type Vars | Expr (',' Expr)*)? ';' Expr? ';' (Expr (',' Expr)*)? | Mod* Type ID Dims ':' Expr
SwitchStmt: 'switch' P[Expr] B[Cases]
Cases: Case*
Case: CaseHead (',' CaseHead)* (':' Stmts | '->' (Expr ';' | B[Stmts] | 'throw' Expr ';')) 
CaseHead: 'case' CaseItem (',' CaseItem)* ('when' Expr)? | 'default'
CaseItem: Expr | Pattern | 'default'
Pattern: Mod* Type ID | Type P[Patterns] ID?
Patterns: (Pattern (',' Pattern)*)?
Expr: Lambda | Unary (Bin Unary | 'instanceof' (Pattern | Mod* Type))* Tail?
Tail: '?' Expr ':' Expr | AssignOp Expr
AssignOp: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '=' | '>' '>' '>' '='
Bin: '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '<=' | '>' '='? | '<<' | '>' '>' '>'? | '&' | '|' | '^' | '&&' | '||'
Lambda: (ID | P[LParams]) '->' (Expr | B[Stmts])
LParams: Params | (ID (',' ID)*)?
Unary: ('+' | '-' | '!' | '~' | '++' | '--')* (P[Cast] Unary | P[Cast] Lambda | Postfix ('++' | '--')*)
Cast: Type ('&' Type)*
Postfix: Primary Suf*
Suf: '.' Targs? (ID | 'this' | 'super' | 'class' | 'new' Creator) | P[Args] | S[Expr] | '::' Targs? (ID | 'new')
Args: (Expr (',' Expr)*)?
Primary: ID | NUM | STR | CHR | 'true' | 'false' | 'null' | 'this' | 'super' | P[Expr] | 'new' Creator | SwitchStmt | Type '::' (ID | 'new') | Prim Dims '.' 'class' | 'void' '.' 'class' | ID ('.' ID)* Dims '.' 'class'
Creator: Annot* Targs? (Prim | ID Targs? ('.' ID Targs?)*) (P[Args] B[Members]? | ArrDims | Dims B[Inits])
ArrDims: S[Expr]+ Dims
"""
JAVA_SOFT = "record sealed permits yield when module"

RUST = r"""
%seq File ';' B
%seq Items ';' B
%seq Block ';'
%seq Any ';' ','
File: Inner* Items
Inner: '#' '!' S[Any]
Items: Item*
Attr: '#' S[Any]
Any: AnyOne*
AnyOne: ANY | P[Any] | S[Any] | B[Any]
Vis: 'pub' P[VisIn]? | 'crate'
VisIn: 'crate' | 'super' | 'self' | 'in' Path
Item: ';' | Attr | Inner | Vis? Def | MacroDef
MacroDef: Path '!' ID? (P[Any] ';' | S[Any] ';' | B[Any])
Def: 'use' Use ';' | 'mod' ID (';' | B[Items]) | 'extern' 'crate' ID ('as' ID)? ';' | FnMods 'fn' ID Generics? P[Params] ('->' Type)? Where? (B[Block] | ';') | 'struct' ID Generics? (Where? B[Fields] | P[Tuple] Where? ';' | ';')
  | 'enum' ID Generics? Where? B[Variants] | 'union' ID Generics? Where? B[Fields] | 'unsafe'? 'impl' Generics? '!'? Type ('for' Type)? Where? B[Items] | 'unsafe'? 'auto'? 'trait' ID Generics? (':' Bounds?)? Where? B[Items]
  | 'type' ID Generics? (':' Bounds)? Where? ('=' Type)? Where? ';' | 'const' (ID | '_') ':' Type ('=' Expr)? ';' | 'static' 'mut'? ID ':' Type ('=' Expr)? ';' | 'unsafe'? 'extern' STR? B[Items]
FnMods: ('const' | 'async' | 'unsafe' | 'default' | 'extern' STR?)*
Use: '::'? (UseSeg '::')* (UseSeg ('as' (ID | '_'))? | '*' | B[Uses])
UseSeg: ID | 'crate' | 'self' | 'super'
Uses: (Use (',' Use)* ','?)?
Generics: '<' (Generic (',' Generic)* ','?)? '>'
Generic: Attr* (LIFE (':' LifeBounds?)? | 'const' ID ':' Type ('=' Expr)? | ID (':' Bounds?)? ('=' Type)?)
LifeBounds: LIFE ('+' LIFE)*
Where: 'where' (Pred (',' Pred)* ','?)?
Pred: LIFE ':' LifeBounds? | ForLt? Type ':' Bounds?
ForLt: 'for' Generics
Bounds: Bound ('+' Bound)* '+'?
Bound: LIFE | '?'? ForLt? Path | P[Bound] | 'use' Generics | '~' 'const' Path
Params: (Param (',' Param)* ','?)?
Param: Attr* (SelfP | Pat ':' Type | '...' )
SelfP: ('&' LIFE?)? 'mut'? 'self' (':' Type)?
Fields: (Field (',' Field)* ','?)?
Field: Attr* Vis? ID ':' Type
Tuple: (Attr* Vis? Type (',' Attr* Vis? Type)* ','?)?
Variants: (Variant (',' Variant)* ','?)?
Variant: Attr* Vis? ID (B[Fields] | P[Tuple])? ('=' Expr)?
Type: '&' LIFE? 'mut'? Type | '&&' LIFE? 'mut'? Type | '*' ('const' | 'mut') Type | S[Slice] | P[Types] | '!' | '_' | ('impl' | 'dyn') Bounds | ForLt? FnMods 'fn' P[FnTypes] ('->' Type)? | ForLt? Path | Qual ('::' PathSeg)+ | Path '!' (P[Any] | S[Any] | B[Any])
FnTypes: (FnT (',' FnT)* ','?)?
FnT: (ID ':' | '_' ':')? Type | '...'
Slice: Type (';' Expr)?
Types: (Bnd (',' Bnd)* ','?)?
Bnd: Type ('+' Bounds)?
Qual: '<' Type ('as' Path)? '>'
Path: '::'? PathSeg ('::' PathSeg)*
PathSeg: (ID | 'crate' | 'self' | 'super' | 'Self') ('::'? GArgs | P[Types] ('->' Type)?)?
GArgs: '<' (GArg (',' GArg)* ','?)? '>'
GArg: LIFE | ID GArgs? '=' Type | ID GArgs? ':' Bounds | Type | NUM | '-' NUM | B[Block] | STR
Pat: '|'? Pat1 ('|' Pat1)*
Pat1: '_' | '..' | 'ref'? 'mut'? ID ('@' Pat1)? | Lit | '-' Lit | '&' 'mut'? Pat1 | '&&' 'mut'? Pat1 | P[Pats] | S[Pats] | PatPath (P[Pats] | B[FPats])? | RangeEnd ('..=' | '..' | '...') RangeEnd? | ('..=' | '..') RangeEnd | 'mut'? 'self' | Path '!' (P[Any] | S[Any]) | 'box' Pat1 | 'const' B[Block]
PatPath: Path | Qual ('::' PathSeg)+
RangeEnd: Lit | '-' Lit | PatPath
Pats: (Attr* Pat (',' Attr* Pat)* ','?)?
FPats: (FPat (',' FPat)* ','?)?
FPat: Attr* ('..' | (ID | NUM) ':' Pat | 'ref'? 'mut'? ID)
Lit: NUM | STR | CHR | 'true' | 'false'
Block: Inner* Stmts
%seq Stmts ';'
Stmts: Stmt*
Stmt: ';' | Attr* Item | Attr* 'let' Pat (':' Type)? ('=' Expr ('else' B[Block])?)? ';' | Attr* BlockExpr | Attr* Expr (';' | END)
BlockExpr: (LIFE ':')? (B[Block] | ('unsafe' | 'async' 'move'? | 'const') B[Block] | 'if' Cond B[Block] ('else' IfElse)? | 'match' Cond B[Arms] | 'loop' B[Block] | 'while' Cond B[Block] | 'for' Pat 'in' Cond B[Block])
IfElse: B[Block] | 'if' Cond B[Block] ('else' IfElse)?
Cond: Expr
Arms: Inner* (Arm (',' | Arm0)?)*
Arm0: 
Arm: Attr* Pat ('if' Expr)? '=>' (Expr | BlockExpr)
Expr: Attr* Operand (Bin Operand | 'as' Type)* Range?
Range: ('..' | '..=') Operand0?
Operand0: Operand (Bin Operand | 'as' Type)*
Operand: ('-' | '!' | '*' | '&' ('mut' | 'raw' ('const' | 'mut'))? | '&&' 'mut'?)* Postfix | ('..' | '..=') Operand0? | Closure | ('return' | 'break' LIFE? | 'yield') Expr? | 'continue' LIFE? | 'let' Pat '=' Operand
Bin: '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' '='? | '<=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>' '>' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '='
Closure: ForLt? ('static' | 'async' | 'move')* ('||' | '|' (CParam (',' CParam)* ','?)? '|') ('->' Type B[Block] | Expr)
CParam: Attr* Pat1 (':' Type)?
Postfix: Primary Suf*
Suf: '?' | '.' 'await' | '.' ID ('::' GArgs)? | '.' NUM | P[Args] | S[Expr]
Args: (Expr (',' Expr)* ','?)?
Primary: Lit | Path | Qual ('::' PathSeg)+ | P[Args] | S[Array] | BlockExpr | Path B[FInits] | Qual ('::' PathSeg)+ B[FInits] | Path '!' (P[Any] | S[Any] | B[Any]) | '_'
Array: Expr ';' Expr | Args
FInits: (FInit (',' FInit)* ','?)?
FInit: Attr* ((ID | NUM) (':' Expr)? | '..' Expr?)
"""
RUST_SOFT = "union auto default box raw"

C = r"""
%seq Unit ';' B
%seq Stmts ';'
%seq Any ';' ','
Unit: (Ext | ';' | PRE)*
Ext: Specs Declarators? ';' | Specs? Declarator KR* B[Stmts] | 'extern' STR (B[Unit] | Ext) | '_Static_assert' P[Args] ';' | ('asm' | '__asm__') P[Any] ';' | ID P[Args]
KR: Specs Declarators ';'
Specs: Spec+
Spec: 'static' | 'extern' | 'inline' | 'const' | 'volatile' | 'register' | 'auto' | 'typedef' | 'restrict' | 'signed' | 'unsigned' | 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | '_Bool' | '_Noreturn' | '_Thread_local' | ID
  | ('struct' | 'union') Attribute* ID? B[Fields] | ('struct' | 'union') ID | 'enum' ID? B[Enums] | 'enum' ID | Attribute | ('_Alignas' | '_Atomic' | 'typeof' | '__typeof__') P[Any]
Attribute: '__attribute__' P[Any] | S[AttrIn] | '__declspec' P[Any]
AttrIn: S[Any]
Any: AnyOne*
AnyOne: ANY | P[Any] | S[Any] | B[Any]
Fields: (Specs FieldDecls? ';' | ';' | PRE)*
FieldDecls: FieldDecl (',' FieldDecl)*
FieldDecl: Declarator (':' Assign)? | ':' Assign
Enums: (Enum (',' Enum)* ','?)?
Enum: PRE* ID ('=' Cond)? PRE*
Declarators: InitDecl (',' InitDecl)*
InitDecl: Declarator (':' Cond)? ('=' Init)?
Declarator: Ptr* Direct DSuf* Attribute*
Ptr: '*' ('const' | 'volatile' | 'restrict' | Attribute)*
Direct: ID | P[Declarator]
DSuf: S[ArrSize] | P[Params]
ArrSize: ('static' | 'const')* ('*' | Assign)?
Params: (Param (',' Param)* (',' '...')?)? | '...' | (ID (',' ID)*)?
Param: Specs (Declarator | Abstract?)
Abstract: Ptr+ ADirect? | ADirect
ADirect: (P[Abstract] | S[ArrSize] | P[Params])+
Init: Assign | B[Inits]
Inits: (IItem (',' IItem)* ','?)? | (IItem (',' IItem)* ','?)? PRE+
IItem: PRE* (Desig+ '=')? Init
Desig: '.' ID | S[Cond] | S[CondRange]
CondRange: Cond '...' Cond
Stmts: Stmt*
Stmt: ';' | PRE | B[Stmts] | Specs Declarators? ';' | Expr ';' | 'if' P[Expr] Stmt ('else' Stmt)? | 'while' P[Expr] Stmt | 'do' Stmt 'while' P[Expr] ';' | 'for' P[ForHead] Stmt | 'switch' P[Expr] Stmt
  | 'case' Cond ('...' Cond)? ':' Stmt? | 'default' ':' Stmt? | 'return' Expr? ';' | 'break' ';' | 'continue' ';' | 'goto' ID ';' | ID ':' Stmt? | ('asm' | '__asm__') 'volatile'? P[Any] ';' | '_Static_assert' P[Args] ';'
ForHead: (Specs Declarators | Expr)? ';' Expr? ';' Expr?
Expr: Assign (',' Assign)*
Assign: Cond (AssignOp Init)?
AssignOp: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>='
Cond: Unary (Bin Unary)* ('?' Expr? ':' Cond)?
Bin: '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '<<' | '>>' | '&' | '|' | '^' | '&&' | '||'
Unary: ('+' | '-' | '!' | '~' | '*' | '&' | '&&' | '++' | '--')* (P[TypeName] Unary | P[TypeName] B[Inits] | Postfix | Sizeof)
Sizeof: ('sizeof' | '_Alignof') (Unary | P[TypeName])
TypeName: Specs Abstract?
Postfix: Primary (P[Args] | S[Expr] | '.' ID | '->' ID | '++' | '--')*
Args: (Arg (',' Arg)*)?
Arg: Assign | TypeName
Primary: ID | NUM | STR+ | CHR | P[Expr] | P[StmtExpr] | '_Generic' P[Any] | STR ID (STR ID?)*
StmtExpr: B[Stmts]
"""

PYTHON = r"""
%seq File NL
%seq Lines NL
File: Lines
Lines: Line*
Line: NL | Simples NL | Compound
Suite: K[Block] | Simples NL
Block: Lines
%seq Block NL
Simples: Simple (';' Simple)* ';'?
Simple: 'pass' | 'break' | 'continue' | 'return' Exprs? | 'raise' (Expr ('from' Expr)?)? | 'global' Ids | 'nonlocal' Ids | 'del' Dels | 'assert' Expr (',' Expr)?
  | 'import' Dotted ('as' ID)? (',' Dotted ('as' ID)?)* | 'from' (('.' | '...')* Dotted | ('.' | '...')+) 'import' ('*' | Froms | P[FromsP]) | 'type' ID TParams? '=' Expr
  | Exprs | (Targets '=')+ (Yield | Exprs) | One AugOp (Yield | Exprs) | One ':' Expr ('=' (Yield | Exprs))? | Yield
Yield: 'yield' ('from' Expr | Exprs)?
Field: (Yield | Exprs) '='? ('!' ID)? (':' STR?)?
Ids: ID (',' ID)*
Dotted: ID ('.' ID)*
Froms: ID ('as' ID)? (',' ID ('as' ID)?)*
FromsP: Froms ','?
AugOp: '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
Targets: Star1 (',' Star1)* ','?
Star1: '*'? Target
Target: ID | Place | P[TargetsIn] | S[TargetsIn]
TargetsIn: (Star1 (',' Star1)* ','?)?
Place: Atom Suf* ('.' ID | S[Subs])
One: ID | Place | P[OneIn]
OneIn: One
Dels: Del (',' Del)* ','?
Del: ID | Place | P[DelsIn] | S[DelsIn]
DelsIn: (Del (',' Del)* ','?)?
Compound: 'if' Named ':' Suite Elif* Else? | 'while' Named ':' Suite Else? | 'async'? 'for' Targets 'in' Exprs ':' Suite Else? | Try | 'async'? 'with' (Withs | P[WithsP]) ':' Suite
  | Decorator* ('async'? 'def' ID TParams? P[Params] ('->' Expr)? ':' Suite | 'class' ID TParams? P[Args]? ':' Suite) | 'match' Exprs1 ':' NL? K[Cases]
Elif: 'elif' Named ':' Suite
Else: 'else' ':' Suite
Try: 'try' ':' Suite (Except+ Else? Finally? | Finally)
Except: 'except' ('*'? Expr ('as' ID)?)? ':' Suite
Exprs1: Named | Exprs
Finally: 'finally' ':' Suite
Withs: With (',' With)*
With: Expr ('as' Target)?
WithsP: With (',' With)* ','?
Decorator: '@' Named NL
Cases: (NL | 'case' Pats ('if' Named)? ':' Suite)+
Pats: Pat (',' Pat)* ','?
Pat: PatOr ('as' ID)?
PatOr: PatAtom ('|' PatAtom)*
PatAtom: '*'? ID | '-'? NUM (('+' | '-') NUM)? | Strings | 'None' | 'True' | 'False' | Dotted P[PatArgs]? | P[PatSeq] | S[PatSeq] | B[PatMap]
PatArgs: ((ID '=')? Pat (',' (ID '=')? Pat)* ','?)?
PatSeq: (Pat (',' Pat)* ','?)?
PatMap: (PatKey (',' PatKey)* ','?)?
PatKey: '**' ID | PatOr ':' Pat
TParams: S[TPs]
TPs: TP (',' TP)* ','?
TP: ('*' | '**')? ID (':' Expr)? ('=' StarExpr)?
Params: (Front (',' Rest?)? | Rest)?
Front: Plains ',' '/' (',' Plains)? (',' Defs)? | Plains ',' Defs ',' '/' (',' Defs)? | Defs ',' '/' (',' Defs)? | Plains (',' Defs)? | Defs
Plains: Plain (',' Plain)*
Plain: ID (':' Expr)?
Defs: Def (',' Def)*
Def: ID (':' Expr)? '=' Expr
Rest: '*' ID (':' StarExpr)? (',' Only)* (',' '**' Plain)? ','? | '*' (',' Only)+ (',' '**' Plain)? ','? | '**' Plain ','?
Only: Plain | Def
StarExpr: '*'? Expr
Exprs: StarExpr (',' StarExpr)* ','?
Named: ID ':=' Expr | Expr
Expr: Lambda | Or ('if' Or 'else' Expr)?
Lambda: 'lambda' LParams ':' Expr
LParams: (LFront (',' LRest?)? | LRest)?
LFront: Ids ',' '/' (',' Ids)? (',' LDefs)? | Ids ',' LDefs ',' '/' (',' LDefs)? | LDefs ',' '/' (',' LDefs)? | Ids (',' LDefs)? | LDefs
LDefs: LDef (',' LDef)*
LDef: ID '=' Expr
LRest: '*' ID (',' LOnly)* (',' '**' ID)? ','? | '*' (',' LOnly)+ (',' '**' ID)? ','? | '**' ID ','?
LOnly: ID | LDef
Or: Not (('or' | 'and') Not)*
Not: 'not'* Operand (Bin Operand)*
Bin: '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '<<' | '>>' | '&' | '^' | '|' | '==' | '!=' | '<' | '<=' | '>' | '>=' | 'in' | 'not' 'in' | 'is' 'not'?
Operand: ('+' | '-' | '~')* 'await'? Postfix
Postfix: Atom Suf*
Suf: '.' ID | P[Args] | S[Subs]
Args: ((Positional (',' Keywords)? | Keywords) ','?)? | GenExp
Positional: Item1 (',' Item1)*
Item1: '*' Expr | Item
Keywords: Key (',' Key)* (',' Map (',' Map1)*)? | Map (',' Map1)*
Key: ID '=' Expr | '*' Expr
Map: '**' Expr
Map1: '**' Expr | ID '=' Expr
Item: ID ':=' Expr | Expr
GenExp: Item CompFor
CompFor: ('async'? 'for' Targets 'in' Or CompIf*)+
CompIf: 'if' Cond1
Cond1: Or | ID ':=' Expr
Subs: Sub (',' Sub)* ','?
Sub: StarExpr | ID ':=' Expr | Expr? ':' Expr? (':' Expr?)?
Strings: STR+ | BYTES+
Atom: ID | NUM | Strings | 'None' | 'True' | 'False' | '...' | P[Paren] | S[ListIn] | B[DictIn]
Paren: Item | Tuple | Yield | GenExp
Tuple: (Star ',' (Star (',' Star)* ','?)?)?
Star: '*' Expr | Item
ListIn: (Star (',' Star)* ','?)? | Item CompFor
DictIn: (Pair (',' Pair)* ','?)? | Star (',' Star)* ','? | Expr ':' Expr CompFor | Item CompFor
Pair: Expr ':' Expr | '**' Expr
"""
PYTHON_SOFT = "match case type _"

RUBY = r"""
%seq File NL ';'
%seq Stmts NL ';'
File: Stmts
Stmts: (Stmt0 | NL | ';')* Stmt?
Sep: NL | ';'
Stmt0: Stmt Sep
Stmt: Expr (ModWord Expr)* | 'alias' Sym Sym | 'undef' Sym (',' Sym)* | 'BEGIN' B[Stmts] | 'END' B[Stmts]
ModWord: 'if_mod' | 'unless_mod' | 'while_mod' | 'until_mod' | 'rescue_mod'
Sym: NAME | STR | OP
Expr: 'not'? Assign (('and' | 'or') NL? 'not'? Assign)*
Assign: Multi '=' (Assign (',' Assign)* | Splats) | Multi | Cond (AssignOp NL? (Assign | Command) (ModRescue)?)? | Command
ModRescue: 'rescue_mod' Assign
Multi: MItem (',' MItem)+ ','?
MItem: '*'? Postfix | P[MultiIn] | '*'
MultiIn: MItem (',' MItem)*
Splats: ('*'? Cond) (',' '*'? Cond)*
AssignOp: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '||=' | '&&=' | '|=' | '&=' | '^=' | '<<=' | '>>='
Command: ('return' | 'break' | 'next' | 'yield' | 'super' | 'redo' | 'retry') CArgs? DoBlock? | Postfix CArgs DoBlock? | 'defined?' Cond | '!' Command
CArgs: CArg (',' NL? CArg)*
CArg: '*' Cond | '**' Cond | '&' Cond | Label NL? Assign | Cond '=>' NL? Assign | Assign1
Assign1: Cond (AssignOp Assign1)? | Lambda
Label: (NAME | STR) ':'
Cond: Operand (Bin NL? Operand)* ('?' NL? Cond NL? ':' NL? Cond)?
Bin: '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '=~' | '!~' | '<' | '<=' | '>' | '>=' | '<=>' | '<<' | '>>' | '&' | '|' | '^' | '&&' | '||' | '..' | '...'
Operand: ('!' | '-' | '+' | '~' | '&' | 'defined?')* Postfix ('..' | '...')? | ('..' | '...') Postfix
Postfix: Primary Suf*
Suf: ('.' | '&.' | '::') NAME ('!' | '?')? | '.' P[Args] | '::' NAME | P[Args] | S[Args] | Block
Block: B[BlockIn] | K[DoIn]
DoBlock: K[DoIn]
BlockIn: ('|' BParams '|')? Stmts
DoIn: 'do' ('|' BParams '|')? Stmts Rescues
BParams: (BParam (',' BParam)* ','? (';' ID (',' ID)*)?)?
BParam: Param | P[BParamsIn]
BParamsIn: BParam (',' BParam)*
Args: NL? (AArg (',' NL? AArg)* ','? NL?)?
AArg: CArg | Label | '*' | '**' | '&' | '...' | Command | Stmt
Lambda: '->' (P[BParams] | BParams) (B[Stmts] | K[DoIn])
Primary: ID ('!' | '?')? | IVAR | NUM | STR+ | REX | SYM | 'nil' | 'true' | 'false' | 'self' | '__FILE__' | '__method__' | P[ParenIn] | S[Args] | B[HashIn] | Lambda | '::' ID | 'super' | 'yield' | K[KwIn] | 'defined?' P[Stmt] | 'raise' | '->'  B[Stmts]
ParenIn: Stmts
HashIn: NL* (HPair (',' NL* HPair)* ','? NL*)?
HPair: Label NL? Assign | Label | Cond '=>' NL? Assign | '**' Cond | STR ':' NL? Assign
KwIn: 'def' DefName (P[Params] | Params0)? (Sep | END)? Stmts Rescues | 'def' DefName P[Params]? '=' Stmt | 'class' ConstPath ('<' Expr)? Sep Stmts Rescues | 'class' '<<' Expr Sep Stmts | 'module' ConstPath Sep Stmts | 'begin' Stmts Rescues
  | ('if' | 'unless') Expr Then Stmts ('elsif' Expr Then Stmts)* ('else' Stmts)? | ('while' | 'until') Expr ('do' | Sep) Stmts | 'for' MFor 'in' Expr ('do' | Sep) Stmts | 'case' Expr? Sep+ ('when' Whens Then Stmts | 'in' Pat Then Stmts)+ ('else' Stmts)?
Then: Sep? 'then' | Sep
MFor: MItem (',' MItem)*
Whens: '*'? Cond (',' NL? '*'? Cond)*
Pat: PatTop (('if_mod' | 'unless_mod' | 'if' | 'unless') Expr)?
PatTop: PatAlt (',' PatAlt)* | PKey (',' PKey)*
PKey: Label PatAlt? | '**' ID | '**' 'nil'
PatAlt: Patom ('|' Patom)* ('=>' ID)?
Patom: Cond | '*' ID? | '^' ID | S[PatS] | B[PatH] | ConstPath (P[PatS] | S[PatS])
PatS: (PatTop ','?)?
PatH: NL? PatTop? NL?
DefName: (('self' | ID) '.')? (NAME ('!' | '?' | '=')? | OP | '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<=>' | '<<' | '>>' | '===' | '=~' | '!' | '~' | '&' | '|' | '^' | '**' | S[Args] '='?)
ConstPath: '::'? ID ('::' ID)*
Params: NL? (Param (',' NL? Param)* ','? NL?)?
Params0: Param (',' Param)*
Param: ID ('=' Cond)? | '*' ID? | '**' (ID | 'nil')? | '&' ID? | ID ':' Cond? | '...' | P[BParamsIn]
Rescues: ('rescue' RescueHead Then0 Stmts)* ('else' Stmts)? ('ensure' Stmts)?
RescueHead: (('*'? Cond) (',' NL? '*'? Cond)*)? ('=>' Postfix)?
Then0: Sep? 'then' | Sep | 
"""

BASH = r"""
%seq File NL ';'
%seq List NL ';'
File: List
List: (Sep | Item)*
Sep: NL | ';'
Item: AndOr (Sep | '&' | END)
AndOr: Pipe (('&&' | '||') NL* Pipe)*
Pipe: ('!' | 'time')* Cmd (('|' | '|&') NL* Cmd)*
Cmd: Simple | Compound Redir* | FuncDef
Simple: (Asg | Redir)+ (Word (Word | Redir | Asg)*)? | Redir* Word (Word | Redir | Asg)*
Asg: ASSIGN P[Any]?
Word: WORD | STR | 'in' | 'time' | '!' 
Redir: RED Word
Any: (ANY | P[Any] | B[Any] | K[KwIn])*
Compound: B[Group] | P[List] | P[Arith] | K[KwIn] | COND
Arith: P[Any]
Group: List
FuncDef: (WORD | STR) P[Empty] NL* Compound | 'function' (WORD | STR) P[Empty]? NL* Compound
Empty: 
KwIn: 'if' List 'then' List ('elif' List 'then' List)* ('else' List)? | ('while' | 'until') List 'do' List | 'for' WORD (NL* 'in' AnyWord*)? Sep* 'do' List | 'for' P[Arith] Sep* 'do' List | 'select' WORD ('in' AnyWord*)? Sep* 'do' List | 'case' Word NL* 'in' Cases
AnyWord: Word | ASSIGN
Sum: (Number (',' Number)*)?
Number: Signed (SumOp Signed)* ('?' Number ':' Number)? | Signed 'A=' Number
SumOp: '+' | '-' | '*' | '/' | '%' | 'A**' | 'A==' | 'A!=' | '<' | '>' | 'A<=' | 'A>=' | 'A<<' | 'A>>' | '&&' | '||' | '&' | '|' | '^'
Signed: ('+' | '-' | '!' | '~' | 'A++')* (WORD | P[Sum]) S[Sum]? 'A++'?
Test: NL* TestOr NL*
TestOr: TestNot (NL* ('&&' | '||') NL* TestNot)*
TestNot: '!'* (P[Test] | WORD 'T2' WORD | 'T1' WORD | WORD | WORD ('<' | '>') WORD)
Cases: (NL | CaseItem)*
CaseItem: PATT List AndOr? (';;' | ';&' | ';;&' | END)
"""

SQL = r"""
%seq Script ';'
Script: (';' | Stmt (';' | END))*
Stmt: Select | Insert | Update | Delete | Create | Drop | Alter | With | Txn | Grant | 'TRUNCATE' 'TABLE'? Name (',' Name)* | 'EXPLAIN' NAME* Stmt | 'USE' Name | 'SET' Any1+ | 'SHOW' Any1+ | 'PRAGMA' Any1+ | 'ANALYZE' Any1* | 'VACUUM' Any1* | 'COMMENT' 'ON' Any1+ | 'CALL' Name P[Args]? | 'DO' Any1+ | 'COPY' Any1+ | 'MERGE' Any1+ | 'EXECUTE' Any1+ | 'DECLARE' Any1+
Any1: ANY | P[AnyIn]
AnyIn: Any1*
Name: NAME ('.' NAME)* | STR
Txn: ('BEGIN' | 'COMMIT' | 'ROLLBACK' | 'SAVEPOINT' | 'START' | 'END' | 'RELEASE') NAME*
Grant: ('GRANT' | 'REVOKE') Any1+
With: 'WITH' 'RECURSIVE'? Cte (',' Cte)* (Select | Insert | Update | Delete)
Cte: NAME P[Names]? 'AS' ('NOT'? 'MATERIALIZED')? P[Query]
Query: Select | With | Insert | Update | Delete
Names: Name (',' Name)*
Select: SelCore (('UNION' | 'EXCEPT' | 'INTERSECT' | 'MINUS') ('ALL' | 'DISTINCT')? SelCore)* OrderBy? Limit*
SelCore: 'SELECT' ('ALL' | 'DISTINCT' ('ON' P[Args])?)? ('TOP' (NUM | P[Expr]))? Cols ('INTO' Name)? From? Where? Group? Having? Window? Qualify? | 'VALUES' P[Args] (',' P[Args])* | P[Query] | 'TABLE' Name
Cols: Col (',' Col)*
Col: '*' | NAME ('.' NAME)* '.' '*' | Expr ('AS'? (NAME | STR))?
From: 'FROM' TRef (',' TRef)*
TRef: TPrim JoinT*
TPrim: 'LATERAL'? (P[Query] | P[TRefIn] | Name P[Args]? | 'UNNEST' P[Args]) ('AS'? NAME P[Names]?)? ('TABLESAMPLE' Any1+)?
TRefIn: TRef (',' TRef)*
JoinT: ('NATURAL'? (('LEFT' | 'RIGHT' | 'FULL') 'OUTER'? | 'INNER' | 'CROSS' | 'SEMI' | 'ANTI')? 'JOIN' | 'STRAIGHT_JOIN') TPrim ('ON' Expr | 'USING' P[Names])?
Where: 'WHERE' Expr
Group: 'GROUP' 'BY' (Expr (',' Expr)* ('WITH' NAME)? | 'ALL')
Having: 'HAVING' Expr
Window: 'WINDOW' NAME 'AS' P[Over] (',' NAME 'AS' P[Over])*
Qualify: 'QUALIFY' Expr
OrderBy: 'ORDER' 'BY' Ord (',' Ord)*
Ord: Expr ('ASC' | 'DESC')? ('NULLS' ('FIRST' | 'LAST'))?
Limit: 'LIMIT' Expr (',' Expr)? | 'OFFSET' Expr ('ROW' | 'ROWS')? | 'FETCH' NAME NUM? NAME NAME | 'FOR' ('UPDATE' | NAME) NAME*
Insert: ('INSERT' ('OR' NAME)? | 'REPLACE') 'IGNORE'? 'INTO' 'TABLE'? Name ('AS' NAME)? P[Names]? ('DEFAULT' 'VALUES' | 'VALUES' P[Args] (',' P[Args])* | Select | With) Conflict? Returning?
Conflict: 'ON' 'CONFLICT' P[Args]? ('WHERE' Expr)? 'DO' ('NOTHING' | 'UPDATE' 'SET' Sets Where?) | 'ON' 'DUPLICATE' 'KEY' 'UPDATE' Sets
Returning: 'RETURNING' Cols
Update: 'UPDATE' Name ('AS'? NAME)? 'SET' Sets From? Where? Returning?
Sets: SetOne (',' SetOne)*
SetOne: Name '=' Expr | P[Names] '=' Expr
Delete: 'DELETE' 'FROM' Name ('AS'? NAME)? ('USING' TRef (',' TRef)*)? Where? Returning?
Create: 'CREATE' ('OR' 'REPLACE')? ('TEMP' | 'TEMPORARY' | 'UNIQUE' | 'EXTERNAL' | 'UNLOGGED' | 'MATERIALIZED' | 'GLOBAL' | 'LOCAL' | 'RECURSIVE')* CreateWhat
CreateWhat: 'TABLE' IfNot? Name (P[Defs] TableOpt* ('AS' Query)? | 'AS' (Query | P[Query]) | 'LIKE' Name) | 'VIEW' IfNot? Name P[Names]? 'AS' Query NAME* | 'INDEX' NAME? IfNot? Name? 'ON' Name ('USING' NAME)? P[IdxCols] ('INCLUDE' P[Names])? Where?
  | ('SCHEMA' | 'DATABASE') IfNot? Any1+ | ('SEQUENCE' | 'EXTENSION' | 'TYPE' | 'DOMAIN' | 'ROLE' | 'USER' | 'FUNCTION' | 'PROCEDURE' | 'TRIGGER') Any1+
IfNot: 'IF' 'NOT' 'EXISTS'
IfEx: 'IF' 'EXISTS'
TableOpt: ','? (NAME '=' (NAME | NUM | STR) | NAME+ ('BY' NAME? P[AnyIn])? | 'WITH' P[AnyIn] | 'ENGINE' '=' NAME | 'COMMENT' '='? STR)
Defs: Def (',' Def)*
Def: Constraint | Name (TypeName ColOpt* | ColOpt*) | 'LIKE' Name
TypeName: NAME ('PRECISION' | 'VARYING')? P[TypeArgs]? ('UNSIGNED' | 'WITH' 'TIME' 'ZONE' | 'WITHOUT' 'TIME' 'ZONE')? S[TypeDim]* ('ARRAY')? ('<' AnyT+ '>')?
AnyT: NAME | ',' | '<' AnyT+ '>' | ':'
TypeDim: NUM?
TypeArgs: (NUM | NAME | STR) (',' (NUM | NAME | STR))*
ColOpt: 'NOT'? 'NULL' | 'PRIMARY' 'KEY' ('ASC' | 'DESC')? | 'UNIQUE' | 'DEFAULT' (Unary) | 'REFERENCES' Name P[Names]? RefOpt* | 'CHECK' P[Expr] | 'CONSTRAINT' NAME | 'AUTO_INCREMENT' | 'AUTOINCREMENT' | 'COLLATE' NAME | 'GENERATED' Any1+ | 'COMMENT' STR | 'IDENTITY' P[TypeArgs]?
RefOpt: 'ON' ('DELETE' | 'UPDATE') ('CASCADE' | 'RESTRICT' | 'SET' ('NULL' | 'DEFAULT') | 'NO' 'ACTION') | 'DEFERRABLE' | 'INITIALLY' NAME | 'MATCH' NAME
Constraint: ('CONSTRAINT' NAME)? ('PRIMARY' 'KEY' P[IdxCols] | 'UNIQUE' ('KEY' | 'INDEX')? NAME? P[IdxCols] | 'FOREIGN' 'KEY' P[Names] 'REFERENCES' Name P[Names]? RefOpt* | 'CHECK' P[Expr] | ('KEY' | 'INDEX') NAME? P[IdxCols] | 'EXCLUDE' Any1+)
IdxCols: IdxCol (',' IdxCol)*
IdxCol: Expr ('ASC' | 'DESC')? ('NULLS' ('FIRST' | 'LAST'))?
Drop: 'DROP' ('TABLE' | 'VIEW' | 'INDEX' | 'SCHEMA' | 'DATABASE' | 'SEQUENCE' | 'TYPE' | 'FUNCTION' | 'TRIGGER' | 'PROCEDURE' | 'MATERIALIZED' 'VIEW' | 'ROLE' | 'USER' | 'EXTENSION') IfEx? Name P[AnyIn]? (',' Name)* ('ON' Name)? ('CASCADE' | 'RESTRICT')?
Alter: 'ALTER' ('TABLE' | 'VIEW' | 'INDEX' | 'SCHEMA' | 'DATABASE' | 'SEQUENCE' | 'TYPE' | 'ROLE' | 'USER') IfEx? Name AltOne (',' AltOne)*
AltOne: 'ADD' ('COLUMN' IfNot?)? Def | 'DROP' ('COLUMN' | 'CONSTRAINT')? IfEx? Name ('CASCADE' | 'RESTRICT')? | 'RENAME' ('COLUMN'? Name)? 'TO' Name | 'ALTER' 'COLUMN'? Name Any1+ | 'MODIFY' 'COLUMN'? Def | 'OWNER' 'TO' NAME | 'SET' Any1+ | 'ADD' Any1+
Expr: 'NOT'* Operand (Bin 'NOT'* Operand | Test)*
Bin: '+' | '-' | '*' | '/' | '%' | '||' | '=' | '==' | '<>' | '!=' | '<' | '<=' | '>' | '>=' | 'AND' | 'OR' | '&' | '|' | '^' | '<<' | '>>' | '->' | '->>' | '~' | '@>' | '<@' | 'NOT'? ('LIKE' | 'ILIKE' | 'REGEXP' | 'RLIKE' | 'GLOB' | 'SIMILAR' 'TO') | 'IS' 'NOT'? ('DISTINCT' 'FROM')? | 'DIV' | 'MOD' | 'COLLATE' | 'ESCAPE' | 'AT' 'TIME' 'ZONE' | ('=' | '<' | '>' | '<>') ('ANY' | 'ALL' | 'SOME')
Test: 'IS' 'NOT'? 'NULL' | 'ISNULL' | 'NOTNULL' | 'NOT'? 'IN' (P[InList] | Name) | 'NOT'? 'BETWEEN' Operand (Bin Operand)* 'AND' Operand
InList: Query | (Expr (',' Expr)*)?
Operand: Unary
Unary: ('+' | '-' | '~')* Primary ('::' TypeName)*
Primary: NUM | STR+ | 'NULL' | 'TRUE' | 'FALSE' | 'DEFAULT' | PARAM | NAME ('.' NAME)* | NAME ('.' NAME)* P[FnArgs] ('FILTER' P[WhereIn])? ('WITHIN' 'GROUP' P[OrderIn])? ('OVER' (NAME | P[Over]))? | P[Args] | P[Query] | 'EXISTS' P[Query] | CaseE | 'CAST' P[CastIn]
  | ('DATE' | 'TIME' | 'TIMESTAMP') STR | 'INTERVAL' (STR | NUM | Expr) NAME? | 'ARRAY' S[Args] | ('ANY' | 'ALL' | 'SOME') P[InList] | 'EXTRACT' P[Extract] | Primary S[Args] | 'NOT' Primary
WhereIn: Where
OrderIn: OrderBy
Extract: NAME 'FROM' Expr
CastIn: Expr 'AS' TypeName
FnArgs: ('DISTINCT' | 'ALL')? ('*' | Expr (',' Expr)*)? OrderBy? (NAME STR)? | Expr NAME* 'FROM' Expr ('FOR' Expr)? | NAME 'FROM' Expr | Expr 'IN' Expr | Query
Args: (Expr (',' Expr)*)?
Over: NAME? ('PARTITION' 'BY' Expr (',' Expr)*)? OrderBy? (('ROWS' | 'RANGE' | 'GROUPS') Any1+)?
CaseE: 'CASE' Expr? ('WHEN' Expr 'THEN' Expr)+ ('ELSE' Expr)? 'END'
"""

JSON = r"""
File: Value
Value: STR | NUM | 'true' | 'false' | 'null' | S[Values] | B[Pairs]
Values: (Value (',' Value)*)?
Pairs: (Pair (',' Pair)*)?
Pair: STR ':' Value
"""

YAML = r"""
File: Doc? (DocMark Doc?)*
DocMark: '---' | '...'
Doc: Node
Node: Entry+ | Item+ | Inline NL K[Flow]? | TXT NL (TXT NL)+
Entry: KEY TAG* NL (K[Node] | Item+)? | KEY TAG* BLOCK NL | KEY Inline NL K[Flow]?
Item: '-' NL K[Node]?
Flow: (TXT NL | STR NL)+
Inline: TAG* (TXT | STR | S[FSeq] | B[FMap] | ALIAS) | TAG+ | TAG* BLOCK
FSeq: (FVal (',' FVal)* ','?)?
FVal: FPair | FNode
FNode: TAG* (TXT | STR | S[FSeq] | B[FMap] | ALIAS)
FMap: ((FPair | FNode) (',' (FPair | FNode))* ','?)?
FPair: (TXT | STR) ':' FNode?
"""


@lru_cache(maxsize=None)
def grammar(language: str) -> Grammar:
    """The grammar of a language, made once per worker."""
    if language == "javascript":
        return Grammar(JS, _CLASSES, JS_SOFT)
    if language == "typescript":
        return Grammar(TS, _CLASSES, TS_SOFT)
    if language == "go":
        return Grammar(GO, _CLASSES)
    if language == "java":
        return Grammar(JAVA, _CLASSES, JAVA_SOFT)
    if language == "rust":
        return _with_any(RUST, RUST_SOFT)
    if language == "c":
        return _with_any(C, "", {"PRE": "#"})
    if language == "python":
        return Grammar(PYTHON, _CLASSES | {"BYTES": "Y"}, PYTHON_SOFT)
    if language == "ruby":
        return Grammar(RUBY, _CLASSES | {"IVAR": "V", "SYM": "Y"}, "raise BEGIN END")
    if language == "bash":
        return _with_any(BASH, "", {"ASSIGN": "A", "RED": "D", "COND": "Q", "PATT": "U"})
    if language == "sql":
        return _with_any(SQL, SQL_SOFT, {"PARAM": "$"}, keyword_names=False)
    if language == "json":
        return Grammar(JSON, _CLASSES)
    if language == "yaml":
        return Grammar(YAML, _CLASSES | {"KEY": "Y", "TXT": "X", "TAG": "G", "ALIAS": "A", "BLOCK": "B"})
    raise KeyError(language)


#: SQL words that may also be names.
SQL_SOFT = ("ACTION ADD ALL_ AT COLUMN COMMENT CONFLICT COPY DATABASE DATE DO DOMAIN ENGINE EXCLUDE EXTENSION FIRST FUNCTION GENERATED GLOBAL GROUPS IDENTITY IGNORE INCLUDE "
            "INDEX INITIALLY KEY LAST LOCAL MATCH MOD NO NOTHING NULLS OFFSET OWNER PROCEDURE RANGE RELEASE RENAME REPLACE ROLE ROW ROWS SCHEMA SEQUENCE SHOW START TEMP TIME TIMESTAMP TOP "
            "TRIGGER TYPE USER INTERVAL VIEW WITHIN ZONE LEFT RIGHT RETURNING IF TRUNCATE TABLESAMPLE LATERAL")


def _with_any(text: str, soft: str, more: dict[str, str] | None = None, keyword_names: bool = True) -> Grammar:
    """A grammar with the class ANY: every token but brackets."""
    classes = _CLASSES | (more or {})
    probe = Grammar(text, classes | {"ANY": "?"}, soft, keyword_names)
    every = "".join(c for c in probe.tokens.values() if c not in "()[]{}") + "".join(classes.values())
    return Grammar(text, classes | {"ANY": every}, soft, keyword_names)


#: Dialects: the rules a file of the language may start from; it is rejected if all of them reject it.
DIALECTS = {
    "javascript": ["Module", "Script"], "typescript": ["Module"], "go": ["File"], "java": ["Unit", "Compact"], "rust": ["File"], "c": ["Unit"],
    "python": ["File"], "ruby": ["File"], "bash": ["File"], "sql": ["Script"], "json": ["File"], "yaml": ["File"],
}
