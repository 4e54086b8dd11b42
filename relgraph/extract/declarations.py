"""Declarations of C# and TypeScript files, and the base types they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relgraph.extract.scopes import FILE, ahead, brace_depth, enclosing, in_file, lines, naive_delta, upto
from relgraph.functions import identity
from relgraph.functions.literals import strip_comment_plain
from relgraph.functions.text import let, lstrip, strip, words

# ---- fixed values -------------------------------------------------------------
TYPE_KEYWORDS = ["class", "interface", "struct", "record", "enum"]
CONTROL_KEYWORDS = ["if", "for", "foreach", "while", "switch", "catch", "using", "lock", "return", "new", "throw",
                    "do", "else", "case", "when", "yield", "await", "nameof", "typeof", "sizeof"]
# -------------------------------------------------------------------------------
_LETTERS = r"\p{IsAlphabetic}\p{N}"


def _plain_code(line: Column) -> dict[str, Column]:
    code = strip_comment_plain(line["raw"])
    return {"code": code, "text": strip(code)}


def _balance(line: Column) -> dict[str, Column]:
    return {"delta": naive_delta(line["text"])}


def _coded(files: DataFrame, *stages) -> DataFrame:
    """Non-blank lines without comments, with their brace balance and depth."""
    found = lines(files, _plain_code, _balance, *stages, keep=lambda l: l["text"] != "", ordered=True)
    return brace_depth(found.drop("raw"))


def _opens(text: Column) -> Column:
    return F.contains(text, F.lit("{"))


def _type_keyword(text: Column) -> Column:
    """``struct<keyword, rest>`` of the first type keyword, in keyword order, that starts a declaration."""
    found = None
    for keyword in TYPE_KEYWORDS:
        pattern = rf"(?:[^A-Za-z0-9_\s:]|[^\s:]\s+){keyword}(?![A-Za-z0-9_])(.*)$"
        hit = F.struct(F.lit(keyword).alias("keyword"), F.regexp_extract(text, pattern, 1).alias("rest"))
        condition = F.contains(text, F.lit(keyword)) & text.rlike(pattern)
        found = F.when(condition, hit) if found is None else found.when(condition, hit)
    return found


def _type_name(keyword: Column, rest: Column) -> Column:
    rest = lstrip(rest)
    bare = F.when(
        keyword == "record", F.regexp_replace(F.regexp_replace(rest, r"^class\s*", ""), r"^struct\s*", "")
    ).otherwise(rest)
    return F.nullif(F.regexp_extract(bare, rf"^([{_LETTERS}_.]+)", 1), F.lit(""))


def _method_name(text: Column) -> Column:
    def named(before: Column, name: Column) -> Column:
        fits = lambda tokens: (F.size(tokens) >= 2) & ~F.exists(tokens, lambda t: t.endswith(":") & (t != ":"))
        return F.when((name != "") & ~name.isin(*CONTROL_KEYWORDS) & let(words(before), fits), name)

    def read(before: Column) -> Column:
        name = F.regexp_extract(before, rf"([{_LETTERS}_]+)[^{_LETTERS}_]*$", 1)
        return F.when(~F.contains(before, F.lit("=")), let(name, lambda n: named(before, n)))

    shaped = F.contains(text, F.lit("(")) & F.contains(text, F.lit(")"))
    return F.when(shaped, let(F.substring_index(text, "(", 1), read))


def _with_keys(decls: DataFrame, base_key: Column) -> DataFrame:
    """Unique keys per file: a repeated key is rewritten, everywhere, with its occurrence."""
    same = W.partitionBy(*FILE, "base_key")
    keyed = decls.withColumn("base_key", base_key)
    occurrence = F.when(
        F.count(F.lit(1)).over(same) > 1, (F.row_number().over(same.orderBy("line")) - 1).cast("long")
    )
    return keyed.withColumn("occurrence", occurrence).withColumn(
        "key",
        F.when(F.col("occurrence").isNotNull(), identity.repeated_key(F.col("base_key"), F.col("occurrence"))).otherwise(
            F.col("base_key")
        ),
    )


def _column_of(code: Column, name: Column) -> Column:
    """0-based column of a name, where it is followed by ``(`` if it is anywhere."""
    called = F.instr(code, F.concat(name, F.lit("(")))
    return F.greatest(F.when(called > 0, called).otherwise(F.instr(code, name)) - 1, F.lit(0)).cast("long")


def _csharp_heads(line: Column) -> dict[str, Column]:
    text = line["text"]
    named = F.nullif(strip(F.rtrim(F.rtrim(F.substring(text, F.lit(11), F.length(text)), F.lit("{")), F.lit(";"))), F.lit(""))
    brace_line = text.startswith("{")
    likely = text.rlike("|".join(TYPE_KEYWORDS)) & ~brace_line & ~text.startswith("namespace ")
    return {
        "brace_line": brace_line,
        "namespace": F.when(text.startswith("namespace "), named),
        "hit": F.when(likely, _type_keyword(text)),
    }


def _csharp_names(line: Column) -> dict[str, Column]:
    member = ~line["brace_line"] & line["namespace"].isNull() & line["hit"].isNull() & F.contains(line["text"], F.lit("("))
    return {
        "type_name": F.when(line["hit"].isNotNull(), _type_name(line["hit"]["keyword"], line["hit"]["rest"])),
        "method": F.when(member, _method_name(line["text"])),
    }


def csharp_lines(files: DataFrame) -> DataFrame:
    """Classified lines of C# files, from which declarations and diagnostics are read."""
    return _coded(files, _csharp_heads, _csharp_names).withColumn(
        "kind",
        F.when(F.col("namespace").isNotNull(), "namespace")
        .when(F.col("type_name").isNotNull(), F.col("hit.keyword"))
        .when(F.col("method").isNotNull(), "method"),
    ).withColumn("name", F.coalesce("namespace", "type_name", "method"))


def csharp_declarations(files: DataFrame, coded: DataFrame | None = None) -> DataFrame:
    """Namespaces, types and methods with their enclosing path and stable key. ``coded``: ``csharp_lines`` where they are at hand."""
    text = F.col("text")
    coded = csharp_lines(files) if coded is None else coded
    file_scoped = (F.col("kind") == "namespace") & text.endswith(";")
    is_scope = F.col("kind").isNotNull() & (F.col("kind") != "method") & ~file_scoped
    waiting = F.when(is_scope & ~_opens(text), F.col("name"))
    is_namespace = F.coalesce(F.col("kind") == "namespace", F.lit(False)).cast("int")
    marked = (
        coded.withColumn("pending", F.lag(waiting).over(in_file()))
        .withColumn(
            "opener",
            F.when(F.col("brace_line"), F.col("pending")).when(is_scope & _opens(text), F.col("name")),
        )
        .withColumn("opener_epoch", F.sum(is_namespace).over(upto(in_file())))
        .withColumn("decl_epoch", F.col("opener_epoch") - is_namespace)
        .withColumn("persistent", F.last(F.when(file_scoped, F.col("name")), ignorenulls=True).over(ahead(in_file())))
        .withColumn("is_decl", F.col("kind").isNotNull())
        .withColumn("column", F.when(F.col("kind") == "method", _column_of(F.col("code"), F.col("name"))).otherwise(
            F.greatest(F.instr(F.col("code"), F.col("name")) - 1, F.lit(0)).cast("long")))
    )
    decls = enclosing(marked, ["kind", "name", "column", "persistent", "text"])
    path = F.concat(F.array_compact(F.array("persistent")), F.col("semantic_path"))
    decls = decls.withColumn("semantic_path", path)
    return _with_keys(
        decls,
        identity.declaration_key(F.col("path"), F.col("kind"), F.concat(F.col("semantic_path"), F.array("name"))),
    ).select(*FILE, "line", "column", "kind", "name", "semantic_path", "base_key", "occurrence", "key", F.col("text").alias("header"))


def csharp_diagnostics(files: DataFrame, coded: DataFrame | None = None) -> DataFrame:
    """Type keywords without a name, unbalanced braces, files without a namespace."""
    coded = csharp_lines(files) if coded is None else coded
    nameless = coded.where(F.col("hit").isNotNull() & F.col("type_name").isNull()).select(
        *FILE, "line", F.lit("csharp-missing-name").alias("code"), F.lit("error").alias("severity")
    )
    totals = coded.groupBy(*FILE).agg(F.sum("delta").alias("depth"), F.count("namespace").alias("namespaces"))
    per_file = files.select(*FILE).join(totals, FILE, "left")
    end = F.lit(None).cast("long")
    unbalanced = per_file.where(F.col("depth") != 0).select(
        *FILE, end.alias("line"), F.lit("csharp-unbalanced-braces").alias("code"), F.lit("error").alias("severity")
    )
    bare = per_file.where(F.coalesce("namespaces", F.lit(0)) == 0).select(
        *FILE, end.alias("line"), F.lit("csharp-missing-namespace").alias("code"), F.lit("warning").alias("severity")
    )
    return nameless.unionByName(unbalanced).unionByName(bare)


def _identifier(text: Column) -> Column:
    return let(F.regexp_extract(text, rf"^([{_LETTERS}_$]+)", 1), lambda name: F.nullif(name, F.lit("")))


def _ts_classified(text: Column) -> Column:
    """``struct<kind, name, quality>`` of a declaration line, else null."""
    exported = lstrip(F.regexp_replace(text, r"^export ", ""))
    bare = lambda body: let(F.regexp_replace(body, r"^abstract ", ""), lambda plain: _ts_shape(body, plain))
    return F.when(
        text.rlike(r"^(?:export|default|abstract|class|interface|namespace|type|async|function|const|let|var)\b"), let(exported, bare)
    )


def _ts_shape(body: Column, plain: Column) -> Column:
    default = F.regexp_replace(body, r"^default ", "")

    def named(kind: str, name: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), name.alias("name"),
            F.when(name.isNotNull(), "explicit").otherwise("anonymous").alias("quality"),
        )

    inner = F.regexp_replace(default, r"^abstract ", "")
    default_name = _identifier(F.regexp_extract(inner, r"^(?:class|function|async function|interface|enum) (.*)$", 1))
    chain = F.when(body.startswith("default "), named("default-export", default_name))
    for word, kind in (("class", "class"), ("interface", "interface"), ("namespace", "namespace"), ("type", "type-alias")):
        pattern = rf"^{word}(?: (.*)|\s*(?=\{{).*|\s*)$"
        chain = chain.when(plain.rlike(pattern), named(kind, _identifier(F.regexp_extract(plain, rf"^{word} (.*)$", 1))))
    function = r"^(?:async )?function (.*)$"
    chain = chain.when(plain.rlike(function), named("function", _identifier(F.regexp_extract(plain, function, 1))))
    variable = r"^(?:const|let|var) (.*)$"
    target = _identifier(F.regexp_extract(plain, variable, 1))
    return chain.when(
        plain.rlike(variable),
        F.struct(F.lit("variable").alias("kind"), target.alias("name"),
                 F.when(target.isNotNull(), "explicit").otherwise("computed").alias("quality")),
    )


def typescript_lines(files: DataFrame) -> DataFrame:
    """Classified lines of TypeScript files, from which declarations and diagnostics are read."""
    return _coded(files, lambda line: {"hit": _ts_classified(line["text"])})


def typescript_declarations(files: DataFrame, coded: DataFrame | None = None) -> DataFrame:
    """Top-level and nested declarations; a nameless one is keyed by its ordinal in the file."""
    coded = typescript_lines(files) if coded is None else coded
    unnamed = F.coalesce(F.col("hit.quality") != "explicit", F.lit(False)).cast("int")
    marked = (
        coded.withColumn("is_decl", F.col("hit").isNotNull())
        .withColumn("opener", F.when(F.col("is_decl") & _opens(F.col("text")), F.coalesce("hit.name", F.lit(""))))
        .withColumn("opener_epoch", F.lit(0))
        .withColumn("decl_epoch", F.lit(0))
        .withColumn("ordinal", F.when(unnamed == 1, F.sum(unnamed).over(upto(in_file()))))
        .select("*", "hit.kind", "hit.name", "hit.quality")
        .withColumn("column", F.coalesce(_column_of(F.col("code"), F.col("name")), F.lit(0)))
    )
    decls = enclosing(marked, ["kind", "name", "quality", "ordinal", "column", "text"])
    key = F.when(
        F.col("quality") == "explicit",
        identity.declaration_key(F.col("path"), F.col("kind"), F.concat(F.col("semantic_path"), F.array("name"))),
    ).otherwise(identity.unnamed_key(F.col("path"), F.col("kind"), F.col("ordinal"), F.col("quality")))
    return _with_keys(decls, key).select(
        *FILE, "line", "column", "kind", "name", "quality", "ordinal", "semantic_path", "base_key", "occurrence", "key",
        F.col("text").alias("header"),
    )


def typescript_diagnostics(files: DataFrame, coded: DataFrame | None = None) -> DataFrame:
    depth = (_coded(files) if coded is None else coded).groupBy(*FILE).agg(F.sum("delta").alias("depth"))
    return depth.where(F.col("depth") != 0).select(
        *FILE, F.lit("typescript-unbalanced-braces").alias("code"), F.lit("error").alias("severity")
    )


def _split_names(clause: Column) -> Column:
    kept = F.substring_index(clause, "where", 1)
    names = F.transform(
        F.split(kept, ","),
        lambda part: F.regexp_extract(strip(F.substring_index(part, "/*", 1)), rf"^([{_LETTERS}_.]*)", 1),
    )
    return F.filter(names, lambda n: n != "")


def base_names(header: Column, language: Column) -> Column:
    """Base types a header names; TypeScript lists the ``extends`` and ``implements`` tails one after the other."""

    def after(mark: str) -> Column:
        return F.when(
            F.contains(header, F.lit(mark)), F.substring(header, F.instr(header, F.lit(mark)) + len(mark), F.length(header))
        ).otherwise(F.lit(""))

    return F.when(language == "csharp", _split_names(after(":"))).otherwise(
        F.concat(_split_names(after("extends")), _split_names(after("implements")))
    )
