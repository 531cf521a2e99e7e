"""The query tools over a code index: each builds one plan and returns a DataFrame.

``CodeIndex`` holds the tables of ``sources.index`` (and, where they exist,
commits, commit_files, prs, pr_commits, pr_files, embeddings, log). Names of
options follow the tools: scope, recent, path/glob, arity, kinds, offset, limit.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import dates as D
from .functions import patterns as P
from .functions import scores as S
from .functions import text as T
from .operators import graph, history, merge, pairs, search, usage, vector
from .operators import keywords as K
from .plans import planner
from .sources.shared import written

# Hits taken from each source before options filter them, compact results of module search.
INTERNAL_LIMIT, MODULE_LIMIT = 100, 20


class CodeIndex:
    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables
        self.spark = tables["modules"].sparkSession

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError as e:
            raise AttributeError(name) from e

    def has(self, name: str) -> bool:
        return name in self.tables

    def documents(self) -> DataFrame:
        """Modules and functions as search documents: type, entity, module, name, arity, file, line, ftype, last_modified_at."""
        when = lambda df: F.col("last_modified_at") if "last_modified_at" in df.columns else F.lit(None).cast("timestamp")
        files = self.modules.select("module", F.col("file").alias("_file"))
        f = self.functions.join(files, "module", "left")
        functions = f.select(F.lit("function").alias("type"), T.canonical(F.col("module"), F.col("name"), F.col("arity")).alias("entity"), "module", "name", F.col("arity").cast("long").alias("arity"), F.col("_file").alias("file"), F.col("line").cast("long").alias("line"), "ftype", when(f).alias("last_modified_at"))
        newest = functions.groupBy("module").agg(F.max("last_modified_at").alias("_newest"))
        m = self.modules.withColumn("last_modified_at", when(self.modules)).join(newest, "module", "left")
        modules = m.select(F.lit("module").alias("type"), F.col("module").alias("entity"), "module", F.col("module").alias("name"), F.lit(None).cast("long").alias("arity"), "file", F.col("line").cast("long").alias("line"), F.lit(None).cast("string").alias("ftype"), F.coalesce("last_modified_at", "_newest").alias("last_modified_at"))
        return modules.unionByName(functions)

    def weighted(self, source: str = "all") -> DataFrame:
        k = self.entity_keywords
        k = k if "source" in k.columns else k.withColumn("source", F.lit("docs"))
        return K.merge_sources((k if source == "all" else k.where(F.col("source") == source)).select("entity", "kw", "source", "weight"))

    def query(self, query, scope: str = "all", recent: bool = False, glob: str | None = None, path: str | None = None, file_type: str | None = None, arity: int | None = None, kinds: str = "all", source: str = "all", offset: int = 0, limit: int = 10, now: datetime | None = None) -> DataFrame:
        """Keyword, wildcard and pattern search: best hit of each name, with tiers; the first relaxation that finds anything if nothing does."""
        said = planner.read_query(query)
        docs = self.documents()
        pattern_hits = [self._pattern_hits(docs, p) for p in said["patterns"]]

        def hits_in(source: str) -> list[DataFrame]:
            return ([self._keyword_hits(docs, said["keywords"], source)] if said["keywords"] else []) + pattern_hits

        hits = hits_in(source)
        if not hits:
            return self._graded(docs.where("false").withColumn("score", F.lit(0.0))).limit(0)
        every = lambda parts: reduce(DataFrame.unionByName, parts)
        found = every(hits).withColumn("_wide", F.lit(False))
        pattern = P.resolve_glob(glob, path, file_type)

        def wanted(scope: str, recent: bool) -> Column:
            is_module, ok = F.col("type") == "module", F.lit(True)
            if recent:
                ok = ok & D.recent(F.col("last_modified_at"), now or datetime.now())
            if scope == "public":
                ok = ok & (is_module | F.coalesce(F.col("ftype").isin("def", "public"), F.lit(False)))
            elif scope == "private":
                ok = ok & F.coalesce(F.col("ftype").isin("defp", "private"), F.lit(False))
            if pattern:
                ok = ok & P.glob(F.col("file"), pattern)
            if arity is not None:
                ok = ok & (is_module | (F.col("arity") == arity))
            return ok if kinds == "all" else ok & (F.col("type") == kinds.rstrip("s"))

        # each relaxation is for itself, as asked but for one option
        tests = [("as asked", ~F.col("_wide") & wanted(scope, recent))]
        if source != "all" and said["keywords"]:
            found = found.unionByName(every(hits_in("all")).withColumn("_wide", F.lit(True)))
            tests.append(("all sources", F.col("_wide") & wanted(scope, recent)))
        tests += [("all scopes", ~F.col("_wide") & wanted("all", recent))] * (scope != "all") + [("older code", ~F.col("_wide") & wanted(scope, False))] * recent
        rows = search.first_of(found, tests, few=True).drop("_wide")
        best = search.best_per_name(rows.drop("stage"), "entity", "score", "name")
        return self._graded(best).orderBy(F.col("score").desc(), "name", "entity").offset(offset).limit(limit)

    def near_terms(self, query, n: int = 5) -> list[str]:
        """Words of the index like those of a query: one holds the other, or they begin alike for four letters or more; the closest in length first."""
        asked = [t for t, _, _ in search.term_groups(planner.read_query(query)["keywords"]) if len(t.strip("*")) > 2]
        if not asked:
            return []
        kw, tests = F.col("kw"), []
        for term in (t.strip("*").lower() for t in asked):
            alike = F.contains(kw, F.lit(term)) | (F.contains(F.lit(term), kw) & (F.length(kw) > 3)) | (F.startswith(kw, F.lit(term[:4])) & F.lit(len(term) > 3))
            tests.append(F.when(alike & (kw != term), F.abs(F.length(kw) - len(term))))
        words = self.entity_keywords.select("kw").distinct().withColumn("apart", F.array_min(F.array_compact(F.array(*tests)))).where("apart is not null")
        return [r["kw"] for r in words.orderBy("apart", "kw").limit(n).collect()]

    def hints(self, query, **options) -> list[str]:
        """What to try when a query found nothing, with words that the index has."""
        return planner.hints(planner.read_query(query), options, self.near_terms(query))

    def _keyword_hits(self, docs: DataFrame, keywords: list[str | list[str]], source: str) -> DataFrame:
        weighted = self.weighted(source)
        weighted = weighted.join(S.zipf(K.document_frequency(weighted)).select("kw", "zipf"), "kw")
        groups = len(keywords)
        flat = [t for t, _, _ in search.term_groups(keywords)]
        if any("*" in t for t in flat):
            scored = search.wildcard(weighted.where(search.any_pattern(keywords)), keywords, groups).select("entity", "score")
        else:
            terms = search.terms(self.spark, keywords)
            scored = search.exact(weighted, terms, groups).select("entity", "score")
            bonus = search.name_hits(docs, T.simple_name(F.col("entity")), terms, weighted)
            both = scored.unionByName(bonus.select("entity", F.col("bonus").alias("score")))
            scored = both.groupBy("entity").agg(F.sum("score").alias("score"))
        scored = scored.withColumn("score", F.round("score", 4))
        dotted = [t for t in flat if "." in t]
        rows = docs.join(scored, "entity", "left" if dotted else "inner")
        if dotted:
            rows = search.module_boost(rows, F.col("module"), [f"*.{t}" for t in dotted]).where("score > 0")
        if self.has("cochange"):
            counts = pairs.partners(self.cochange, 1_000_000).groupBy("item").agg(F.sum("cnt").alias("_n"))
            rows = rows.join(counts, rows["file"] == counts["item"], "left").withColumn("score", F.col("score") * F.when(F.col("type") == "module", search.cochange_factor(F.col("_n"))).otherwise(search.cochange_factor(None, None, F.col("_n")))).drop("item", "_n")
        return rows.orderBy(F.col("score").desc(), "name", "entity").limit(INTERNAL_LIMIT).select(*docs.columns, "score")

    def _pattern_hits(self, docs: DataFrame, pattern: str) -> DataFrame:
        if "." not in pattern and "/" not in pattern and ":" not in pattern:
            hit = P.any_of(F.col("name"), pattern)
        else:
            hit = (F.col("type") == "function") & P.function_match(pattern, F.col("module"), F.col("file"), F.col("name"), F.col("arity"))
            hit = hit | ((F.col("type") == "module") & P.any_of(F.col("module"), pattern, P.qualified))
        return docs.where(hit).withColumn("score", F.lit(1.0)).orderBy("name", "entity").limit(INTERNAL_LIMIT)

    def _graded(self, rows: DataFrame) -> DataFrame:
        out = S.distribution(rows, few=True)  # INTERNAL_LIMIT rows a source at most
        return out.withColumn("tier", S.tier(F.col("z"))).drop("mean", "sd")

    def call_sites(self, functions: DataFrame | None = None) -> DataFrame:
        """Resolved calls of the functions (all): (module, name, arity)."""
        return graph.call_sites(self.calls, self.functions if functions is None else functions, self.aliases)

    def search_function(self, pattern: str, usage_type: str = "all", glob: str | None = None, changed_since: str | None = None, now: datetime | None = None, offset: int = 0, limit: int = 10) -> DataFrame:
        """Definitions that match, with their calling modules; of fallbacks the first that finds any."""
        docs = self.documents().where("type = 'function'")
        if glob:
            docs = docs.where(P.glob(F.col("file"), glob))
        if changed_since:
            docs = docs.where(D.since(F.col("last_modified_at"), changed_since, now or datetime.now()))
        match = lambda p: P.function_match(p, F.col("module"), F.col("file"), F.col("name"), F.col("arity"))
        found = search.first_of(docs, [(note, match(p)) for note, p in planner.relaxed(pattern)])
        # of clauses and repeated definitions the first line
        found = written(graph.consolidate(found, ["module", "name"], "arity", ["line", "file"]))
        # only calls of what was found are gathered
        sites = self.call_sites(found.select("module", "name", "arity"))
        if usage_type != "all":
            test = P.is_test_usage(F.col("caller_file"))
            sites = sites.where(test if usage_type == "tests" else ~test)
        callers = graph.consolidate(sites.select("target", "callee", "arity", "caller_module", "line"), ["target", "callee", "arity"], "caller_module", ["line"])
        callers = callers.groupBy(F.col("target").alias("module"), F.col("callee").alias("name"), F.col("arity").cast("long").alias("arity")).agg(F.array_sort(F.collect_list(F.struct("caller_module", "line"))).alias("callers"))
        out = found.join(callers, ["module", "name", "arity"], "left")
        return out.orderBy("module", "name", "arity").offset(offset).limit(limit)

    def search_module(self, name: str, offset: int = 0, limit: int = MODULE_LIMIT) -> DataFrame:
        """Modules by name or file, with counts of their functions; ``*.Last`` if the full name finds none."""
        m = self.modules
        match = lambda p: P.any_of(F.col("module"), p, P.qualified) | P.any_of(F.col("file"), p)
        found = search.first_of(m, [("as asked", match(name)), ("last segment", match("*." + name.rsplit(".", 1)[-1]))])
        counts = self.functions.groupBy("module").agg(F.count("*").alias("functions"), F.count_if(F.col("ftype").isin("def", "public")).alias("public"))
        return found.join(counts, "module", "left").orderBy("module").offset(offset).limit(limit)

    def module_usage(self, module: str) -> DataFrame:
        """(kind, module) of mentions and (call, module) of calls."""
        refs = graph.usages(self.module_refs, F.lit(module))
        calls = graph.resolve(self.calls, self.aliases).where((F.col("target") == module) & (F.col("caller_module") != module))
        return refs.unionByName(calls.select(F.lit("call").alias("kind"), F.col("caller_module").alias("module")).distinct())

    def dependencies(self, module: str, depth: int = 2) -> DataFrame:
        """(node, depth) of the modules that a module depends on."""
        resolved = graph.resolve(self.calls, self.aliases)
        edges = resolved.select(F.col("caller_module").alias("src"), F.col("target").alias("dst")).unionByName(self.module_refs.select(F.col("module").alias("src"), F.col("target").alias("dst")))
        edges = edges.where("src <> dst").distinct()
        return graph.closure(edges, self.spark.createDataFrame([(module,)], "root string"), depth).select("node", "depth")

    def dead_code(self, least: str = "high") -> DataFrame:
        """Public functions without callers, at a confidence of ``least`` or more."""
        files = self.modules.select("module", "file")
        dynamic = self.module_refs.where("kind in ('use', 'behaviour')").select("module").distinct().withColumn("_d", F.lit(True))
        f = self.functions.join(files, "module").join(dynamic, "module", "left")
        impl = F.coalesce(F.col("impl"), F.lit(False)) if "impl" in f.columns else F.lit(False)
        f = f.withColumns({"is_public": F.col("ftype").isin("def", "public"), "is_test": P.is_test_path(F.col("file")), "is_impl": impl, "dynamic": F.coalesce("_d", F.lit(False))}).drop("_d")
        sites = self.call_sites().select(F.col("target").alias("module"), F.col("callee").alias("name"), "arity")
        mentions = self.module_refs.where("kind = 'value_mention'").select(F.col("target").alias("module"))
        out = graph.dead_code(f, sites, mentions, ["module", "name", "arity"])
        return out.where(graph.at_least(F.col("confidence"), least)).select("module", "name", "arity", "file", "line", "confidence")

    def git_history(self, file=None, author: str | None = None, text: str | None = None, recent: bool | None = None, now: datetime | None = None, limit: int = 10) -> DataFrame:
        """Commits by file, author, message and age, with their pull requests; ``recent``: within 14 days, False: before."""
        rows = self.commits
        if file is not None:
            rows = rows.join(self.commit_files.where(F.col("file") == file).select("sha").distinct(), "sha", "left_semi")
        if author:
            rows = history.by_author(rows, author)
        if text:
            rows = history.search(rows, text, 500)
        if recent is not None:
            fresh = D.recent(F.col("ts"), now or datetime.now())
            rows = rows.where(fresh if recent else ~fresh)
        rows = rows.orderBy(F.col("ts").desc(), "sha").limit(limit)
        return history.with_pr(rows, self.pr_commits, self.prs) if self.has("prs") else rows

    def query_json(self, query: str, sample: bool = False) -> DataFrame:
        """JSON path queries over one document for each module; anything else is SQL over the tables."""
        functions = self.functions.groupBy("module").agg(F.collect_list(F.struct("name", "arity", "ftype", "line")).alias("functions"))
        doc = self.modules.join(functions, "module", "left").select(F.to_json(F.struct("module", "file", "line", "moduledoc", "functions")).alias("doc"))
        return planner.json_query(doc, "doc", query, sample)

    def expand(self, identifier: str) -> DataFrame:
        """A module if one has that name, else functions."""
        if "/" not in identifier and not self.modules.where(F.col("module") == identifier).isEmpty():
            return self.search_module(identifier)
        return self.search_function(identifier)

    def suggest(self, terms: list[str], n: int = 10) -> DataFrame:
        """Keywords that occur with the terms."""
        return pairs.suggest(self.weighted(), "entity", "kw", [t.lower() for t in terms], n)

    def semantic(self, vector_: list[float], k: int = 10) -> DataFrame:
        return vector.top_k(self.embeddings, vector_, k)

    def usage(self, days: int | None = None, now: datetime | None = None) -> DataFrame:
        log = self.log if days is None else self.log.where(D.recent(F.col("ts"), now or datetime.now(), days))
        return usage.by_tool(log)

    def refresh(self, fresh: dict[str, DataFrame], changed: DataFrame) -> CodeIndex:
        """A new index in which all rows of changed or deleted files (path) are those of ``fresh``."""
        gone = self.modules.join(changed.select(F.col("path").alias("file")), "file", "left_semi").select("module")
        out = dict(self.tables)
        for name, key in (("modules", "module"), ("functions", "module"), ("calls", "caller_module"), ("aliases", "module"), ("module_refs", "module"), ("entity_keywords", "module")):
            out[name] = merge.replace_files(self.tables[name], fresh[name], gone.withColumnRenamed("module", key), key)
        return CodeIndex(out)
