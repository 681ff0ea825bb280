"""Valid files of each language, each between lines of three equals signs."""

TS = r'''
try { a(); } catch { b(); }
===
const k = ["a", "b"] as const;
===
type F = (x: number, y?: string) => void;
===
let f: (x: number) => void = (x) => { use(x); };
===
interface I { run(x?: number): string; readonly a: number; [key: string]: any; new (x: number): I; (y: string): void; opt?(): void }
===
abstract class A { abstract run(): void; abstract get x(): number; protected abstract y: string; }
===
function* g() { yield* h(); yield 1; const x = yield; }
===
class D { @Input() name: string; @Output() change = new Emitter<string>(); @Prop({ a: 1 }) readonly b?: number; }
===
export * as ns from "./x";
===
type Box<T = string, U extends object = {}> = { value: T; other: U };
===
async function r() { for await (const x of xs) { use(x); } }
===
const m: Map<string, number[]> = new Map<string, number[]>();
===
function id<T extends { a: string }>(x: T): T { return x; }
===
const f = async <T,>(x: T): Promise<T> => x;
===
type M = { [K in keyof T]?: T[K] };
===
type C = A extends B ? X : never;
===
function isS(x: unknown): x is string { return typeof x === "string"; }
===
declare module "x" { export function f(a: number): void; }
===
declare const VERSION: string;
===
enum E { A = 1, B, C = "x" }
===
const enum K { A }
===
namespace N.M { export const a = 1; }
===
export type { T } from "./t";
===
import type { T, U } from "./t";
===
import x, { type Y } from "./z";
===
import z = require("z");
===
export = foo;
===
export default class extends B { constructor(private a: string, public readonly b = 2) { super(); } }
===
label: for (let i = 0, n = 3; i < n; i++) { if (i) continue label; else break label; }
===
do { x(); } while (y);
===
switch (a) { case 1: case 2: b(); break; default: { c(); } }
===
const { a, b: { c = 1 }, ...rest } = obj;
===
const [x, , y = 2, ...zs] = arr;
===
a ??= b; a ||= c; a &&= d; a **= 2;
===
const o = { get x() { return 1; }, set x(v) { this.y = v; }, async *gen() { yield 1; }, [k]: 2, "s-t": 3, 4: 5, m<T>(x: T) { return x; }, ...p };
===
x = a ? b : c ? d : e;
===
const re = /ab+[/]c/gi.test(s) && s.replace(/\//g, "x");
===
if (a) b(); else if (c) d(); else { e(); }
===
while (a) b();
===
for (const k in o) if (o.hasOwnProperty(k)) use(k);
===
throw new Error(`bad ${x}`);
===
var self = this, n = 1;
===
new Foo;
===
(function () { "use strict"; })();
===
(() => { a(); })();
===
const v = <any>x;
===
let u: A | B & C = y!;
===
let t: [string, number?, ...boolean[]] = z as unknown as [string];
===
function over(a: string): void; function over(a: number): void; function over(a: any) { }
===
class P { #secret = 1; static #count = 0; static { init(); } get s() { return this.#secret; } declare y: number; }
===
const big = 1_000n + 0xffn;
===
a?.b?.[0]?.(c);
===
delete a.b, void 0, typeof x;
===
export { a, b as c }; export { default } from "./d"; export { default as e, f } from './e';
===
let fn: typeof import("./x");
===
type T1 = `a${string}b`;
===
const s = x satisfies Y;
===
abstract class Q<T> extends R<T> implements S, U<T> { private constructor() { super(); } }
===
let x: unique symbol; let y: readonly string[]; let z: keyof typeof o;
===
function assertX(x: any): asserts x is string { }
===
for (;;) { break; }
===
if (a) { } else { }
;;
===
const f = function named(a = 1, { b, c } = {}) { return a; };
===
let a = b
let c = d
(e || f).g()
===
const x = {
  a,
  b,
}
foo()
===
@Component({ selector: "x" })
export class Z { @HostListener("click", ["$event"]) onClick(e: Event) { } }
===
type R = Record<string, Array<Map<string, () => void>>>;
===
const a = b < c && d > (e);
===
let x = a as any as B, y = c!.d![0]!;
===
export const f = (a: number): string => { return `${a}`; };
===
const p = new Promise<void>((resolve, reject) => { setTimeout(() => resolve(), 1); });
===
return_ = a in b, c instanceof D;
===
type G = new (...args: any[]) => object;
===
declare global { interface Window { x: number } }
===
let v: -1 | 1 | "a" | null | undefined = null;
===
function f(this: Window, ...rest: string[]): void { }
===
class A { x = 1
  y
  "quoted" = 2
  m() { } }
===
import "./side.css";
===
import def, * as all from "x";
===
const t = a ? (b) : (c);
===
const t2 = a ? (b, c) => d : e => f;
===
get(a).set(b).of(c).type;
===
const type = 1, of = 2, get = 3, async = 4, from = 5, as = 6; type.of(get);
===
async () => { await a; };
===
export async function* s(): AsyncGenerator<number> { }
===
declare function f(x: number): string;
===
const z1 = (a, b) => ({ a, b });
===
let q = "\
continued";
===
if (x) return;
'''
TSX = r'''
const a = <div className="x" {...p} key={1}>text {b} <br /> &nbsp; it's</div>;
===
const b = <A.B render={() => <C />} on={(e) => f(e)}>{list.map((x) => <li key={x}>{x}</li>)}</A.B>;
===
const c = cond ? <a /> : <b>{null}</b>;
===
const d = <>{/* note */}<x-y data-a="1" aria-label='z' /></>;
===
function F<T,>(p: P<T>) { return <div>{p.a < 3 && <b>{p.b}</b>}</div>; }
===
const e = (<p>a &gt; b, "c" and {"{"}</p>);
===
const f = <input disabled value={v} onChange={async (e) => { await g(e.target.value); }} />;
===
const g = useState<string | null>(null);
===
const h = <svg:path d="M0 0" xlink:href="#a" />;
'''
HCL = r'''
locals { a = [for s in var.l : upper(s) if s != ""] }
===
locals { b = { for k, v in var.m : k => v... } }
===
output "x" { value = aws_x.y[*].id }
===
locals { c = "${lookup(var.m, "k")}-${var.a ? "x" : "y"}" }
===
resource "a" "b" { count = var.x == "" ? 0 : 1
  lifecycle { ignore_changes = [tags, name] }
  dynamic "setting" { for_each = var.s
    content { name = setting.value["name"] } } }
===
variable "v" { type = map(object({ a = string, b = optional(number, 3) }))
  default = {} }
===
locals { d = <<-EOT
    text { [ ${var.a}
  EOT
}
===
provider "p" { alias = "x" }
terraform { required_version = ">= 1.0"
  backend "s3" { } }
===
locals { e = !var.a && (var.b || -1 < 2) , }
===
locals { e = cidrsubnet(var.c, 8, count.index + 1) % 2 }
===
module "m" { source = "./m"
  providers = { aws = aws.x }
  x = module.y.z["k"].w[0] }
===
# comment
// other
/* block */
locals {
  f = "%{ if var.x }a%{ else }b%{ endif }"
  g = { "a b" = 1, (var.k) = 2, c : 3 }
  h = [
    1,
    2,
  ]
  i = var.x.*.id
}
===
moved {
  from = a.b
  to   = a.c
}
===
locals { j = null, }
'''
YAML = r'''
? k
: v
===
? [a, b]
: - x
  - y
? c
===
a: &x
  b: 1
c:
  <<: *x
  d: !!str 2
e: !tag {a: b, c: [d]}
===
--- 
a: 1
...
---
- b
===
- - a
  - b
- c: d
  e: f
===
a: >-
  folded
  text: with colon

  more
b: |2
    kept
c: x
===
"q k": 'it''s'
url: http://a.b/c:d
time: 12:30:45
===
a:
- b
- c:
    d: e
===
key: "multi
  line"
other: plain
  goes on
===
{a: 1, "b": [2, 3,], c: {d: e}}
===
[a,
 b]
===
just text
===
a: # comment
  b: c # more
# end
===
a: |
  x

b: ""
c: ~
===
%YAML 1.2
---
a: b
===
- |
  text
- >
  more
- "x"
===
a: [
  b, c
]
d: {
  e: f
}
===
on:
  push:
    branches: [ main, 'rel/**' ]
jobs:
  x:
    steps:
    - uses: a/b@v1
      with: { k: "${{ secrets.X }}" }
    - run: |
        echo "a: b"
        if [ x ]; then y; fi
'''
DOCKER = r'''
FROM a
VOLUME ["/data"]
SHELL ["/bin/bash", "-c"]
===
FROM a
RUN <<EOF
set -e
echo "x
EOF
CMD x
===
# syntax=docker/dockerfile:1
ARG V=1
FROM --platform=$BUILDPLATFORM a:${V} AS build
ENV A=1 B="two words" C=three\ words
ENV OLD value with words
LABEL a.b="c" \
      d="e"
EXPOSE 80/tcp 443
HEALTHCHECK --interval=5m --timeout=3s CMD curl -f http://x/ || exit 1
HEALTHCHECK NONE
USER 1000:1000
ONBUILD RUN make
STOPSIGNAL SIGTERM
ADD --chown=a:b ["x y", "z"]
COPY --from=build /a /b /c/
COPY <<EOF /etc/x
text here
EOF
ENTRYPOINT ["a", "-b"]
CMD a $B | c > d 2>&1; e & f
===
FROM scratch
COPY . .
===
FROM a
RUN if [ -f x ]; then y; else z; fi; for i in 1 2; do echo $i; done && (cd a && b) || { c; }
===
FROM a
RUN --mount=type=cache,target=/x apt-get update \
    # comment
    && apt-get install -y \
       a b \
    && rm -rf /x/*
MAINTAINER me <a@b.c>
WORKDIR $HOME/x
ARG X
ARG Y="a b"
RUN echo 'it''s' "a \"b\"" $(date +%s) `x`
RUN ["a", "b"]
===
from a as b
run x
'''
HTML = r'''
<!DOCTYPE html>
<html lang=en><head><meta charset=utf-8><title>a</title><link rel="x" href=y><style>a > b {}</style><script>if (a < b) { c("</div>"); }</script></head>
<body class='x' data-a><p>a<p>b &amp; c<br/><img src="x" alt=""><ul><li>a<li>b</ul><table><tr><td>x<td>y</table>
<form><input type=checkbox checked><select><option>a<option selected>b</select><textarea>x <b></textarea></form>
<dl><dt>a<dd>b</dl><!-- c --><svg viewBox="0 0 1 1"><path d="M0"/></svg></body></html>
===
<div>a</div>
<p>b</p>
===
<html><body><table><thead><tr><th>a</th></tr></thead><tbody><tr><td>1</td></tr></tbody></table></body></html>
===
<!doctype html>
<title>x</title>
<p>text
===
<html>
<head></head>
<body>
<h1>a</h1> 1 < 2 is text
</body>
</html>
===
<html><head><title>x</title></head><body><video controls><source src="a"></video><template><p>x</p></template></body></html>
'''
PY = r'''
match x:
    case {"a": [1, *_]} if y: pass
    case A(b=1) | None: ...
===
def f(a, /, b: int = 1, *, c, **k) -> dict[str, int]: return {**k, "x": (y := 3)}
===
async def g():
    async with a as b, c: yield await d
    return [x async for x in y if x]
===
@d(1)
class A[T](B, metaclass=M): x: int = 1
===
try: a
except* E as e: raise X from e
finally: del b
===
print(f"{a!r:>{w}} {'x' if b else "y"}"); lambda *a, k=1: a
===
type X[T] = list[T]
'''
