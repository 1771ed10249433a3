from docweave.parsing import typescript as ts


def names(kind, text):
    return [s["qualified_name"] for s in ts.parse("src/a.ts", text)["symbols"] if s["kind"] == kind]


def calls(text):
    return [(c["caller_symbol_id"], c["callee_name"]) for c in ts.parse("src/a.ts", text)["calls"]]


def test_functions():
    text = """
export function one(a: number): { x: number } { return two(a) }
export default async function () { one(1) }
const three = async (x) => x + 1;
let four = function named() { three() }, five = y => four(y)
function outer() { function inner() { outer() } return inner }
foo(function callback() { bar() })
"""
    found = ts.parse("src/a.ts", text)
    assert names("function", text) == ["one", "default", "three", "four", "five", "outer", "inner"]
    one = found["symbols"][0]
    assert (one["id"], one["exported"], one["is_default_export"]) == ("src/a.ts#one:function", True, False)
    assert one["location"] == {"startLine": 2, "startColumn": 1, "endLine": 2, "endColumn": 64}
    assert found["symbols"][1]["is_default_export"]
    assert ("src/a.ts#inner:function", "outer") in calls(text) and (None, "bar") in calls(text) and (None, "foo") in calls(text)


def test_classes():
    text = """
/** A service.
 * @since 1 */
export class Auth<T> extends Base<T> implements Other {
  private cache: Map<string, number> = new Map();
  constructor(private x: number) { super(); this.start() }
  async login(user: string): Promise<{ ok: boolean }> { return check(user) }
  get value() { return 1 }
  set value(v) { this.x = v }
  static handle = () => { helper() };
  abstract none(): void;
  [Symbol.iterator]() { hidden() }
}
"""
    found = ts.parse("src/a.ts", text)
    assert names("class", text) == ["Auth"]
    assert names("method", text) == ["Auth.constructor", "Auth.login", "Auth.value", "Auth.value", "Auth.handle", "Auth.none"]
    assert all(s["parent_id"] == "src/a.ts#Auth:class" and not s["exported"] for s in found["symbols"][1:])
    assert [u["description"] for u in found["unsupported"]] == ["Computed method name is not modeled"]
    assert found["symbols"][0]["doc"].startswith("/** A service.")
    assert calls(text) == [
        ("src/a.ts#Auth.constructor:method", "this.start"), ("src/a.ts#Auth.login:method", "check"), ("src/a.ts#Auth.handle:method", "helper"),
    ]


def test_imports_and_exports():
    text = """
import a, { b as c, type d } from './x'
import * as ns from "../y";
import type { T } from './t';
import './side';
export * from './all'; export * as n from './n';
export { a as z, c };
export const { p } = a;
export default a;
export = a;
"""
    found = ts.parse("src/a.ts", text)
    assert [(i["specifier"], i["default_local"], i["namespace_local"], i["type_only"], [(n["imported"], n["local"]) for n in i["named"]]) for i in found["imports"]] == [
        ("./x", "a", None, False, [("b", "c"), ("d", "d")]), ("../y", None, "ns", False, []), ("./t", None, None, True, [("T", "T")]), ("./side", None, None, False, []),
    ]
    assert [(e["exported_name"], e["local_name"], e["re_export_from"]) for e in found["exports"]] == [
        ("*", None, "./all"), ("n", None, "./n"), ("z", "a", None), ("c", "c", None), ("default", "a", None),
    ]
    assert [u["description"] for u in found["unsupported"]] == ["Destructured export binding is not modeled", "CommonJS-style `export =` is not modeled"]


def test_calls_only_of_plain_names():
    text = "a.b.c(d()); x?.y(); arr[0](); foo().bar(); new Thing(q()); g<string>(1); `${t(1)} ${'}'}`; if (k) { r = /a(b)/.test(s) }"
    assert [c for _, c in calls(text)] == ["a.b.c", "d", "foo", "q", "g", "t"]


def test_parse_files(spark):
    rows = [("src/a.ts", "export const f = () => g()"), ("src/b.js", None), ("src/c.ts", "{{{ ((")]
    got = {r.path: r for r in ts.parse_files(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert [s.name for s in got["src/a.ts"].symbols] == ["f"] and got["src/b.js"].symbols == [] and got["src/c.ts"].calls == []


def test_tokens_of_a_large_file_stay_small():
    import tracemalloc

    text = "export class N {\n" + "".join(f"  m{i}() {{ return 1 }}\n" for i in range(5000)) + "}\n"
    tracemalloc.start()
    tokens = ts.tokenize(text)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(tokens) == 35005 and held < 30 * len(tokens)
    assert [t.text for t in tokens[4:11]] == ["m0", "(", ")", "{", "return", "1", "}"]


def test_a_file_goes_out_before_the_next_is_read():
    import pyarrow as pa

    texts = [f"export function f{i}() {{ g() }}" for i in range(3)] + ["x`a${b()}c`", None]
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i}.ts" for i in range(5)]), pa.array(texts)], ["path", "content"])
    out = list(ts._parse_batches(iter([batch])))
    assert [b.num_rows for b in out] == [1] * 5
    for i, b in enumerate(out):
        row = b.to_pylist()[0]
        assert row.pop("path") == f"{i}.ts" and row == ts.parse(f"{i}.ts", texts[i] or "")
