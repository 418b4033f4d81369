"""Reference resolution as joins: each way to resolve gives (reference, priority, target) rows, and the lowest priority wins."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import language_group
from ..lineage import cut
from ..model import BUILTINS, QUIET_NAMES
from . import indexes

#: Outside names' containments are numbered in so many parts.
PARTS = 64
TYPES = ("class", "interface")


@dataclass
class Resolution:
    resolved: DataFrame
    unresolved: DataFrame
    diagnostics: DataFrame
    externals: DataFrame
    containments: DataFrame


def first_of(steps: list[tuple[str, DataFrame]], key: str, target: str) -> DataFrame:
    """(key, target, method): of the steps' (key, target) rows those of the first step that has any for the key, there the smallest target."""
    rows = [df.select(key, target, F.lit(i).alias("_step"), F.lit(method).alias("method")) for i, (method, df) in enumerate(steps)]
    best = reduce(DataFrame.unionAll, rows).groupBy(key).agg(F.min(F.struct("_step", target, "method")).alias("m"))
    return best.select(key, F.col(f"m.{target}").alias(target), F.col("m.method").alias("method"))


def first_by(offers: DataFrame, target: str, *keys: str) -> DataFrame:
    """(keys..., target): of the symbols that share the keys, the first; so that a reference meets one of them only, however common the name."""
    return offers.groupBy(*keys).agg(F.min_by(target, "sym_seq").alias(target))


def normal_path(path: Column) -> Column:
    """A path without empty, `.` and (as far as there is something above) `..` parts."""
    start = F.array().cast("array<string>")
    up = lambda acc: (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
    fold = lambda acc, p: F.when(p.isin("", "."), acc).when((p == "..") & (F.size(acc) > 0), F.when(up(acc), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), start, fold), "/")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def target_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(ref_seq, file): the file that each import means, by module name first, else the first file whose path ends with it."""
    lang = language_group(F.col("path"))
    dots = F.length(F.regexp_extract("import_path", "^(/*)", 1))
    here = folder(F.col("path"))
    # n dots: n - 1 folders up from the file's own
    above = F.aggregate(F.sequence(F.lit(1), F.greatest(dots, F.lit(1))), here, lambda acc, i: F.when(i == 1, acc).otherwise(folder(acc)))
    rest = F.regexp_replace("import_path", "^/+", "")
    python = F.when(dots > 0, normal_path(F.concat_ws("/", above, rest))).otherwise(F.col("import_path"))
    beside = normal_path(F.concat_ws("/", here, F.col("import_path")))
    bare = F.regexp_replace("import_path", r"^[./]+", "")
    no_ext = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    java = F.replace(F.regexp_replace("import_path", r"\.\*$", ""), F.lit("."), F.lit("/"))
    names = F.when(lang == "py", F.array(python, F.concat(python, F.lit(".py")), F.concat(python, F.lit("/__init__.py")), F.replace(python, F.lit("/"), F.lit("."))))
    names = names.when(lang == "typescript", F.transform(F.array(*map(F.lit, ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"))), lambda x: F.concat(beside, x)))
    names = names.when(lang == "html", F.array(beside, no_ext(beside))).otherwise(F.array().cast("array<string>"))
    tail = F.when(lang == "py", python).when(lang == "java", F.when(~F.col("import_path").endswith("*"), java)).when(lang == "html", no_ext(bare)).when(lang == "typescript", bare)
    wanted = imports.select("ref_seq", F.posexplode(names).alias("place", "module"))
    by_module = wanted.join(indexes.modules(files).hint("merge"), "module").groupBy("ref_seq").agg(F.min_by("path", "place").alias("file"))
    # Every ending of every file's path is a key, so that "ends with" is an equi-join.
    endings = files.withColumn("bare", F.regexp_replace("path", r"\.(py|[jt]sx?|java|html)$", "")).where(F.length("bare") > 0)
    endings = endings.select("file_seq", "path", F.explode(F.transform(F.sequence(F.lit(1), F.length("bare")), lambda i: F.substr("bare", i))).alias("tail"))
    endings = endings.groupBy("tail").agg(F.min_by("path", "file_seq").alias("tail_file"))
    by_tail = imports.withColumn("tail", tail).where(F.length("tail") > 0).join(endings.hint("merge"), "tail").select("ref_seq", "tail_file")
    both = imports.select("ref_seq").join(by_module.hint("merge"), "ref_seq", "left").join(by_tail.hint("merge"), "ref_seq", "left")
    return both.select("ref_seq", F.coalesce("file", "tail_file").alias("file")).where(F.col("file").isNotNull())


def resolve_imports(imports: DataFrame, symbols: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ref_seq, to_id) of imports, those of outside names too, and the outside symbols made for them."""
    imports = imports.where(F.col("import_path").isNotNull())
    name = F.coalesce("imported_name", "raw_name")
    lang = language_group(F.col("path"))
    wants = imports.select("ref_seq", "path", "import_path", "raw_name", "ast_node_type", name.alias("name"), lang.alias("lang")).join(target_files(imports, files), "ref_seq", "left")
    offers = symbols.where((F.col("kind") != "file") & F.col("exported"))
    in_file = first_by(offers.select(F.col("path").alias("file"), "sym_seq", F.col("id").alias("to_id"), F.explode(F.array_distinct(F.array("name", "qname"))).alias("name")), "to_id", "file", "name")
    everywhere = first_by(offers.select("name", language_group(F.col("path")).alias("lang"), "sym_seq", F.col("id").alias("to_id")), "to_id", "name", "lang")
    whole = (F.col("lang") == "html") | (F.col("lang") == "py") & (F.col("ast_node_type") == "import_statement")
    file_id = F.concat(F.col("file"), F.lit("::"), F.col("file"))
    is_module = (F.col("lang") == "py") & ((F.col("file") == F.col("name")) | F.col("file").endswith(F.concat(F.col("name"), F.lit(".py"))))
    steps = [
        ("import", wants.where(whole & F.col("file").isNotNull()).select("ref_seq", file_id.alias("to_id"))),
        ("import", wants.where(~whole & F.col("file").isNotNull()).join(in_file, ["file", "name"])),
        ("import", wants.where(~whole & F.col("file").isNotNull() & is_module).select("ref_seq", file_id.alias("to_id"))),
        ("import", wants.where(F.col("lang") != "html").join(everywhere, ["name", "lang"])),
    ]
    found = first_of(steps, "ref_seq", "to_id").drop("method")
    top = lambda c: F.split_part(c, F.lit("/"), F.lit(1))
    tops = files.select(top(F.col("path")).alias("top")).distinct()
    missing = wants.join(found, "ref_seq", "left_anti").withColumn("top", F.when(F.col("lang") == "java", F.split_part("import_path", F.lit("."), F.lit(1))).otherwise(top(F.col("import_path"))))
    outside = missing.join(tops.where(~F.col("top").isin("", ".", "..")), "top", "left_anti")
    outside = outside.withColumn("to_id", F.concat_ws("::", F.lit("external"), "import_path", "name"))
    made = external(outside.select(F.col("to_id").alias("id"), "name", F.concat_ws(".", F.replace("import_path", F.lit("/"), F.lit(".")), "name").alias("qname"), F.lit("external").alias("path"), F.lit("variable").alias("plain")))
    return found.unionAll(outside.select("ref_seq", "to_id")), made


def external(rows: DataFrame) -> DataFrame:
    """Symbols for outside names: classes if they begin with a capital, else of the kind `plain`."""
    initial = F.substr("name", F.lit(1), F.lit(1))
    capital = (initial == F.upper(initial)) & (initial != F.lower(initial))
    return rows.withColumn("kind", F.when(capital & (F.col("plain") != "function"), "class").otherwise(F.col("plain"))).select("id", "kind", "name", "qname", "path").dropDuplicates(["id"])


def types_of(symbols: DataFrame, wants: DataFrame) -> DataFrame:
    """(key, type_id) for wants(key, type_chain, path): the first class or interface of the language with the qualified, else the last name."""
    t = symbols.where(F.col("kind").isin(*TYPES)).select("sym_seq", F.col("id").alias("type_id"), "name", "qname", language_group(F.col("path")).alias("lang"))
    w = wants.where(F.size("type_chain") > 0).select("key", "type_chain", language_group(F.col("path")).alias("lang"))
    dotted = w.where(F.size("type_chain") > 1).withColumn("qname", F.array_join("type_chain", ".")).join(first_by(t, "type_id", "qname", "lang"), ["qname", "lang"])
    plain = w.withColumn("name", F.element_at("type_chain", -1)).join(first_by(t, "type_id", "name", "lang"), ["name", "lang"])
    return first_of([("", dotted), ("", plain)], "key", "type_id").drop("method")


def member_table(symbols: DataFrame, containments: DataFrame) -> DataFrame:
    """(at, name, to_id): the first member of a name in each symbol; a variable has those of its declared type behind its own."""
    named = symbols.select(F.col("id").alias("child_id"), "name").dropDuplicates(["child_id"])
    own = containments.join(named, "child_id").groupBy(F.col("parent_id").alias("at"), "name").agg(F.min_by("child_id", "cont_seq").alias("to_id"))
    typed = types_of(symbols, symbols.where((F.col("kind") == "variable") & F.col("declared_chain").isNotNull()).select(F.col("id").alias("key"), F.col("declared_chain").alias("type_chain"), "path"))
    typed = typed.where(F.col("key") != F.col("type_id"))
    through = typed.join(own.withColumnRenamed("at", "type_id"), "type_id").select(F.col("key").alias("at"), "name", "to_id")
    return own.unionAll(through.join(own, ["at", "name"], "left_anti"))


def follow(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rows(ref_seq, priority, at, chain, pos): each chain followed from its place through members; (…, to_id) where it ends. Outside symbols have every member."""
    done = []
    while True:  # a round for each name of the longest chain
        done.append(rows.where(F.col("pos") >= F.size("chain")).select("ref_seq", "priority", F.col("at").alias("to_id")))
        rows = rows.where(F.col("pos") < F.size("chain")).withColumn("name", F.element_at("chain", F.col("pos") + 1))
        outside = F.col("at").startswith("external::")
        rows = rows.join(members, ["at", "name"], "left").withColumn("to_id", F.coalesce("to_id", F.when(outside, F.concat_ws("::", "at", "name"))))
        rows = cut(rows.where(F.col("to_id").isNotNull()).select("ref_seq", "priority", F.col("to_id").alias("at"), "chain", (F.col("pos") + 1).alias("pos")))
        if rows.isEmpty():
            break
    return reduce(DataFrame.unionAll, done)


def resolve_all(refs: DataFrame, symbols: DataFrame, scopes: DataFrame, containments: DataFrame, local_bindings: DataFrame, files: DataFrame) -> Resolution:
    """All references of a project. files(file_seq, path); tables as in the model."""
    symbols = cut(indexes.by_id(symbols))
    imports = refs.where(F.col("kind") == "import")
    found_imports, outside = resolve_imports(imports, symbols, files)
    found_imports = cut(found_imports)
    # The last import of a name in a file counts.
    imported = found_imports.join(imports.select("ref_seq", "path", "raw_name"), "ref_seq").groupBy("path", "raw_name").agg(F.max_by("to_id", "ref_seq").alias("import_id"))
    others = refs.where(F.col("kind") != "import").withColumn("chain", F.when(F.size("chain") > 0, F.col("chain")).otherwise(F.array("raw_name")))
    others = others.withColumn("lang", language_group(F.col("path"))).withColumn("base", F.col("chain")[0])
    receiver = F.col("base").isin("this", "self") & (F.size("chain") > 1)
    plain, own = cut(others.where(~receiver)), others.where(receiver)
    members = cut(member_table(symbols, containments))
    order = lambda step, a=F.lit(0), b=F.lit(0): F.struct(F.lit(step).alias("step"), a.cast("long").alias("a"), b.cast("long").alias("b")).alias("priority")
    start = lambda df, step, at, pos, a=F.lit(0), b=F.lit(0): df.select("ref_seq", order(step, a, b), F.col(at).alias("at"), "chain", pos.alias("pos"))
    one = F.lit(1)

    # this and self: members of the enclosing class
    parent = containments.where(F.col("kind").isin("owns", "has_member")).groupBy("child_id").agg(F.min_by("parent_id", "cont_seq").alias("parent_id"))
    level = cut(own.select("ref_seq", "chain", F.col("from_id").alias("child_id"), F.array().cast("array<string>").alias("passed")))
    classes = symbols.where(F.col("kind").isin("class", "interface", "struct")).select(F.col("id").alias("parent_id"), F.lit(True).alias("is_class"))
    enclosing = []
    while not level.isEmpty():
        up = cut(level.where(~F.array_contains("passed", F.col("child_id"))).join(parent, "child_id").join(classes, "parent_id", "left"))
        enclosing.append(start(up.where("is_class"), 0, "parent_id", one))
        level = up.where("is_class is null").select("ref_seq", "chain", F.col("parent_id").alias("child_id"), F.concat("passed", F.array("child_id")).alias("passed"))

    # scopes from the innermost out: a symbol of the name, else the declared type of a local one
    inner = indexes.innermost(plain.withColumn("id", F.col("ref_seq")), scopes, exclude_own=False).select(F.col("id").alias("ref_seq"), "scope_id")
    around = inner.join(indexes.scope_ancestors(scopes), "scope_id").select("ref_seq", F.col("anc_id").alias("scope_id"), "depth")
    around = cut(plain.select("ref_seq", "base", "chain", "path").join(around, "ref_seq"))
    declared = indexes.innermost(symbols, scopes, exclude_own=True).join(symbols.select("id", "name", "sym_seq"), "id").groupBy("scope_id", F.col("name").alias("base")).agg(F.min_by("id", "sym_seq").alias("at"))
    lexical = around.join(declared, ["scope_id", "base"])
    owner = scopes.select(F.col("id").alias("scope_id"), "owner_symbol_id")
    bound = around.where(F.size("chain") > 1).join(lexical.select("ref_seq", "scope_id"), ["ref_seq", "scope_id"], "left_anti").join(owner, "scope_id").join(indexes.bindings(local_bindings).withColumnRenamed("name", "base"), ["owner_symbol_id", "base"])
    bound = bound.withColumn("key", F.concat_ws("|", "ref_seq", "depth"))
    bound = bound.join(types_of(symbols, bound.select("key", "type_chain", "path")), "key")
    # imports, the longest prefix first
    prefixes = plain.select("ref_seq", "path", "chain", F.explode(F.sequence(one, F.size("chain"))).alias("n")).withColumn("raw_name", F.array_join(F.slice("chain", one, F.col("n")), ".")).join(imported, ["path", "raw_name"])
    tries = [
        *enclosing,
        start(lexical, 1, "at", one, F.col("depth")),
        start(bound, 1, "type_id", one, F.col("depth"), one),
        prefixes.select("ref_seq", order(2, -F.col("n")), F.col("import_id").alias("at"), "chain", F.col("n").alias("pos")),
    ]
    followed = follow(reduce(DataFrame.unionAll, tries), members)

    # the qualified name, then the name anywhere in the language, then the built-in names
    where_ = symbols.select("sym_seq", F.col("id").alias("at"), "name", "qname", "kind", language_group(F.col("path")).alias("lang"))
    exact = plain.where(F.size("chain") > 1).withColumn("qname", F.array_join("chain", ".")).join(first_by(where_, "at", "qname", "lang"), ["qname", "lang"]).select("ref_seq", order(3), F.col("at").alias("to_id"))
    files_last = F.col("kind").isin("file", "project").cast("int")
    anywhere = where_.groupBy(F.col("name").alias("base"), "lang").agg(F.min_by("at", F.struct(files_last, F.col("sym_seq"))).alias("at"))
    somewhere = plain.join(anywhere, ["base", "lang"]).select("ref_seq", "chain", "at")
    builtin = plain.where(F.col("base").isin(*BUILTINS)).select("ref_seq", "chain", F.concat(F.lit("external::builtin::"), F.col("base")).alias("at"))
    far = follow(start(somewhere, 4, "at", one).unionAll(start(builtin, 5, "at", one)), members)
    bases = somewhere.select("ref_seq", order(4, one), F.col("at").alias("to_id"))  # stands even where its member is missing

    every = followed.unionByName(exact).unionByName(far).unionByName(bases)
    best = every.groupBy("ref_seq").agg(F.min(F.struct("priority", "to_id")).alias("m")).select("ref_seq", F.col("m.priority.step").alias("step"), F.col("m.to_id").alias("to_id"))
    by_step = F.when(F.col("step") <= 2, "scope").when(F.col("step") == 3, "qualified_name").otherwise("global_fallback")
    local = imported.select("path", F.col("raw_name").alias("base"), F.lit(True).alias("is_import"))
    best = best.join(others.select("ref_seq", "id", "from_id", "kind", "path", "base"), "ref_seq").join(local, ["path", "base"], "left")
    second = best.select("ref_seq", F.col("id").alias("candidate_id"), "from_id", "to_id", "kind", F.when((F.col("step") <= 2) & F.col("is_import"), "import").otherwise(by_step).alias("method"))
    first = found_imports.join(imports.select("ref_seq", "id", "from_id", "kind"), "ref_seq").select("ref_seq", F.col("id").alias("candidate_id"), "from_id", "to_id", "kind", F.lit("import").alias("method"))
    resolved = cut(first.unionAll(second))
    unresolved = refs.join(resolved.select("ref_seq"), "ref_seq", "left_anti")
    is_import = F.col("kind") == "import"
    quiet = ~is_import & F.lower("raw_name").isin(*QUIET_NAMES)
    message = F.when(is_import, F.format_string("Unable to resolve import path or name for '%s' in %s", F.col("raw_name"), F.coalesce("import_path", F.lit("unknown path")))).otherwise(F.format_string("Reference '%s' could not be resolved", F.col("raw_name")))
    told = unresolved.where(~quiet).select(F.when(is_import, "unresolved_import").otherwise("unresolved_reference").alias("kind"), F.when(is_import, "warning").otherwise("info").alias("severity"), message.alias("message"), "path", "sl", "sc")

    # outside symbols that were met on the way, and who holds them
    reached = resolved.where(F.col("to_id").startswith("external::")).select(F.col("to_id").alias("id")).distinct()
    known = outside.select("id")
    parts = F.split("id", "::")
    deep = reached.join(known, "id", "left_anti")
    links = deep.select("id", parts.alias("p")).select(F.explode(F.transform(F.sequence(F.lit(3), F.size("p")), lambda n: F.struct(F.array_join(F.slice("p", 1, n), "::").alias("id"), F.when(n > 3, F.array_join(F.slice("p", 1, n - 1), "::")).alias("parent_id"), F.element_at("p", n).alias("name"), F.concat_ws(".", F.when(F.col("p")[1] != "builtin", F.replace(F.col("p")[1], F.lit("/"), F.lit("."))), F.array_join(F.slice("p", 3, n - 2), ".")).alias("qname")))).alias("x")).select("x.*").distinct()
    new = links.select("id", "name", "qname", F.when(F.col("id").startswith("external::builtin::"), "builtin").otherwise("external").alias("path"), F.when(F.col("parent_id").isNull(), "function").otherwise("method").alias("plain"))
    externals = outside.unionByName(external(new).join(known, "id", "left_anti")).dropDuplicates(["id"])
    last = containments.agg(F.coalesce(F.max("cont_seq"), F.lit(0))).first()[0]
    part = F.pmod(F.xxhash64("child_id"), F.lit(PARTS))
    held = links.where(F.col("parent_id").isNotNull()).select("parent_id", F.col("id").alias("child_id"), F.lit("has_member").alias("kind"), part.alias("part"))
    held = held.withColumn("cont_seq", F.lit(last + 1 - PARTS) + F.row_number().over(Window.partitionBy("part").orderBy("child_id")) * PARTS + F.col("part"))
    return Resolution(resolved, unresolved, told, externals, held.select("cont_seq", "parent_id", "child_id", "kind"))
