"""Extraction on small files, with facts worked out by hand."""

from pyspark.sql import functions as F

from relgraph.extract import declarations, endpoints, manifests, usage
from relgraph.functions import literals
from tests.helpers import files, rows

NESTED = """namespace Shop.Core
{
    public interface IClock
    {
        void Now();
    }
    // class Ghost {
    internal sealed class Clock<T> : IClock where T : class
    {
        private class Inner
        {
            public enum Kind { A }
            public int Deep(int a) { if (a > 0) { return a; } return 0; }
        }
        public int After(string s)
        {
            return s.Length;
        }
    }

    class Pending

    void NotPending() { }
}
namespace Shop.Other {
    record Point(int X);
}
"""


def decls(spark, text, path="a.cs"):
    found = declarations.csharp_declarations(files(spark, (path, text)))
    return [
        (r.line, r.kind, r.name, tuple(r.semantic_path)) for r in found.orderBy("line").collect()
    ]


def test_csharp_scopes(spark):
    assert decls(spark, NESTED) == [
        (1, "namespace", "Shop.Core", ()),
        (3, "interface", "IClock", ("Shop.Core",)),
        (5, "method", "Now", ("Shop.Core", "IClock")),
        (8, "class", "Clock", ("Shop.Core",)),
        (10, "class", "Inner", ("Shop.Core", "Clock")),
        (12, "enum", "Kind", ("Shop.Core", "Clock", "Inner")),
        (13, "method", "Deep", ("Shop.Core", "Clock", "Inner")),
        (15, "method", "After", ("Shop.Core", "Clock")),
        (23, "method", "NotPending", ("Shop.Core",)),
        (25, "namespace", "Shop.Other", ()),
        # a type keyword at the start of a line declares no type, and two words before "(" are a method
        (26, "method", "Point", ("Shop.Other",)),
    ]


def test_a_type_keyword_needs_something_before_it(spark):
    assert decls(spark, "class Bare\n{\n}\npublic class Named { }\n") == [(4, "class", "Named", ())]


def test_file_namespace_persists_and_a_block_namespace_clears_outer_scopes(spark):
    text = "namespace A;\npublic class X {\nnamespace B {\npublic class Y {\n}\n}\n}\n"
    assert decls(spark, text) == [
        (1, "namespace", "A", ()),
        (2, "class", "X", ("A",)),
        (3, "namespace", "B", ("A", "X")),
        (4, "class", "Y", ("A", "B")),
    ]


def test_csharp_diagnostics(spark):
    df = files(spark, ("ok.cs", "namespace A { }\n"), ("bad.cs", "public class\n{\n"), ("empty.cs", ""))
    assert rows(declarations.csharp_diagnostics(df), "path", "code") == sorted(
        [
            ("bad.cs", "csharp-missing-name"), ("bad.cs", "csharp-unbalanced-braces"), ("bad.cs", "csharp-missing-namespace"),
            ("empty.cs", "csharp-missing-namespace"),
        ],
        key=repr,
    )


def test_repeated_keys_are_all_rewritten(spark):
    text = "namespace A {\n  public class C {\n    void M(int a) { }\n    void M(string a) { }\n    void One() { }\n  }\n}\n"
    found = {r.line: r for r in declarations.csharp_declarations(files(spark, ("a.cs", text))).collect()}
    assert found[3].base_key == found[4].base_key
    assert len({found[3].key, found[4].key, found[3].base_key}) == 3
    assert (found[3].occurrence, found[4].occurrence, found[5].occurrence) == (0, 1, None)
    assert found[5].key == found[5].base_key


def test_span_text(spark):
    df = files(spark, ("a.cs", NESTED))
    line_of = NESTED.split("\n")
    for r in declarations.csharp_declarations(df).collect():
        assert line_of[r.line - 1][r.column:].startswith(r.name)


def test_typescript_shapes(spark):
    text = (
        "export interface Id { v: string }\nexport abstract class Widget {\n  render() {}\n  let inner = 1;\n}\n"
        "type Alias = Id;\nconst { left, right } = pair();\nexport default function () {\n}\nasync function go() {}\n"
        "class {\n}\nvar $x = 1;\nconst [a] = b;\n"
    )
    found = declarations.typescript_declarations(files(spark, ("a.ts", text))).orderBy("line").collect()
    assert [(r.kind, r.name, r.quality, r.ordinal, tuple(r.semantic_path)) for r in found] == [
        ("interface", "Id", "explicit", None, ()),
        ("class", "Widget", "explicit", None, ()),
        ("variable", "inner", "explicit", None, ("Widget",)),
        ("type-alias", "Alias", "explicit", None, ()),
        ("variable", None, "computed", 1, ()),
        ("default-export", None, "anonymous", 2, ()),
        ("function", "go", "explicit", None, ()),
        ("class", None, "anonymous", 3, ()),
        ("variable", "$x", "explicit", None, ()),
        ("variable", None, "computed", 4, ()),
    ]


def test_base_names(spark):
    df = spark.createDataFrame(
        [("public class A : B<int>, App.IC /* x */ where T : class", "csharp"), ("class P extends Q implements R, S {", "typescript"), ("class P", "csharp")],
        "h string, l string",
    )
    got = [tuple(r[0]) for r in df.select(declarations.base_names(F.col("h"), F.col("l"))).collect()]
    assert got == [("B", "App.IC"), ("Q", "S", "R", "S"), ()]


def test_sql_literals(spark):
    text = (
        'db.Run("SELECT a FROM dbo.T"); x = $"SELECT {a} FROM t";\n'
        'db.Run("UPDATE t SET " + name);\n'
        "db.Run('EXEC [sales].[sp]'); // \"DELETE FROM no\"\n"
        'db.Run("SELECT ""q"" FROM q1"); y = "hello select";\n'
        "db.Run(`INSERT INTO t`);\n"
        'open = "SELECT a FROM never\n'
    )
    got = rows(usage.sql_literals(files(spark, ("a.cs", text))), "line", "operation", "schema", "object", "status", "reason")
    assert got == sorted(
        [
            (1, "select", "dbo", "T", "access", None),
            (1, "select", None, None, "unresolved", "unresolved-dynamic-sql"),
            (2, "update", None, None, "unresolved", "unresolved-dynamic-sql"),
            (3, "stored_procedure", "sales", "sp", "access", None),
            (4, "select", None, "q1", "access", None),
            (5, "insert", None, None, "unresolved", "unresolved-dynamic-sql"),
        ],
        key=repr,
    )


def test_controller_routes_survive_braces_in_strings_and_nested_types(spark):
    text = (
        '[Route("api/[controller]")]\npublic class ItemsController : ControllerBase\n{\n  [HttpGet("{id}")]\n  public IActionResult Get(int id) => Ok("}");\n'
        '  [HttpPost]\n  public IActionResult Create([FromBody] Item i) { return Ok(i); }\n  [Microsoft.AspNetCore.Mvc.HttpPutAttribute("/abs//x")]\n  public void Abs() { }\n'
        '  [HttpGet($"/i/{x}")]\n  public void Dyn() { }\n}\n[HttpGet("x")]\npublic void Loose() { }\n'
    )
    got = rows(endpoints.controller_routes(files(spark, ("c.cs", text))), "action", "template", "verbs", "status")
    assert got == sorted(
        [
            ("Get", "api/Items/{id}", ("GET",), "endpoint"), ("Create", "api/Items/Create", ("POST",), "endpoint"),
            ("Abs", "abs/x", ("PUT",), "endpoint"), ("Dyn", None, None, "unresolved"),
        ],
        key=repr,
    )


def test_build_file_element_runs_to_the_next_self_close(spark):
    text = '<PackageReference Include="A"><Version>1</Version></PackageReference>\n<PackageReference Include="B" Version="2" />'
    got = rows(manifests.build_file_facts(files(spark, ("a.csproj", text))), "key", "value")
    assert got == [("dependency-version:A", "2"), ("dependency-version:B", "2"), ("dependency:A", "A"), ("dependency:B", "B")]


def test_kubernetes_manifest(spark):
    text = (
        "apiVersion: v1\nkind: Deployment\nspec:\n  containers:\n    image: app:1\n    env:\n    - name: API_TOKEN\n      value: hidden\n"
        "    - name: MODE\n      value: \"fast\"\n"
    )
    got = rows(manifests.manifest_hints(files(spark, ("k.yaml", text))), "line", "status", "key", "value")
    assert got == [(10, "hint", "MODE", "fast"), (5, "hint", "image", "app:1"), (8, "redacted", "API_TOKEN", None)]
    other = files(spark, ("readme.md", "hello"))
    assert rows(manifests.unrecognised_manifests(other), "path", "code") == [("readme.md", "manifest-not-recognised")]


def test_partition_count_does_not_matter(spark):
    df = files(spark, *[(f"f{i}.cs", NESTED) for i in range(9)])
    one = rows(declarations.csharp_declarations(df.repartition(1)), "path", "line", "key")
    many = rows(declarations.csharp_declarations(df.repartition(7).orderBy(F.rand(3))), "path", "line", "key")
    assert one == many


TWO_CONTROLLERS = """[Route("a/[controller]")]
public class OneController
{
    [HttpGet("x")]
    public int Get() { return 1; }
    public void Plain() { if (x) { } }
    [HttpPut]
    public int Put() { return 1; }
}
[HttpGet("gone")]
public int Outside() { return 1; }
[Route("b")]
public class TwoController
{
    [HttpGet("y")]
    public int Get() { return 1; }
}"""


def test_controllers_of_a_file_are_told_apart_in_one_order(spark):
    found = endpoints.controller_routes(files(spark, ("a.cs", TWO_CONTROLLERS)))
    assert sorted(rows(found, "line", "controller", "template", "status")) == [
        (5, "OneController", "a/One/x", "endpoint"), (8, "OneController", "a/One/Put", "endpoint"), (16, "TwoController", "b/y", "endpoint")]
    sorts = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Sort [" in line]
    assert sorts and "segment" not in "".join(sorts)


def test_plain_literals_and_brackets_need_no_fold(spark):
    df = spark.createDataFrame([('[HttpGet("a]")]  ', '"a"', "{{}"), ('[A], [B("x")]', 'n, "b"', "'{' {"), ('[a[b]]', '"c\\"d"', '"}" }'), ("[x] y", "", "")], "line string, args string, code string")
    got = df.select(endpoints.bracket_groups(F.col("line")).alias("g"), literals.first_literal_argument(F.col("args")).alias("a"), literals.brace_delta(F.col("code")).alias("d"))
    assert [(r.g, r.a, r.d) for r in got.collect()] == [(['HttpGet("a]")'], "a", 1), (["A", 'B("x")'], "b", 1), (["a[b]"], 'c"d', -1), (["x"], None, 0)]


def test_sections_of_a_manifest_are_carried_in_one_order(spark):
    text = "services:\n  web:\n    image: a\n    environment:\n      KEY: v\n  db:\n    host: h\nservices:\n  late:\n    image: b"
    found = manifests.manifest_hints(files(spark, ("docker-compose.yml", text)))
    assert sorted(rows(found, "line", "status", "provenance")) == [
        (3, "hint", "compose:services.web.image"), (5, "hint", "compose:services.web.KEY"), (7, "hint", "compose:services.web.host"),
        (10, "hint", "compose:services.late.image")]
    steps = found._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [s for s in steps if "Sort [" in s and "block" in s]
    # the row of a hint is made once, not again for each of its fields
    assert max(s.count("unresolved-dynamic-value") + s.count("depends_on") for s in steps) < 6
