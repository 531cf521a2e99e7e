"""Source scans over programs that are composed of the documents' lines.

A document is a file with one module; a line of n words is a function named after
the first, with the others as parameters, whose body calls them all inside one
another. Where n is odd the function lies in a module of its own; the line itself
is its documentation, with whatever code words it has.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import elixir
from . import adapters as A
from .registry import query

#: Documents of a task: their programs are four times the text.
DOCUMENTS = 500

#: What a line gives: its words, and a text that closes no string.
_SQL_LINES = """ln as (select file, line, regexp_extract_all(text, '[a-z]+') as words, len(regexp_extract_all(text, '[a-z]+')) as n from source_lines where text is not null),
placed as (select *, 2 + coalesce(sum(case when n = 0 then 1 when n % 2 = 1 then 10 else 8 end) over (partition by file order by line rows between unbounded preceding and 1 preceding), 0) as spot from ln)"""


def elixir_files(t):
    """files(file, source): see above."""
    words = F.transform(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)), lambda w: F.concat(w, F.lit("_")))
    # dealt by file before they become lines and tokens, which then stay in their tasks
    whole = t.documents.select(F.col("doc_id").cast("string").alias("file"), "text").repartition(t.parts("documents", rows=DOCUMENTS), "file")
    lines = whole.select("file", F.posexplode(F.split("text", "\n")).alias("line", "text")).select("file", (F.col("line") + 1).cast("bigint").alias("line"), "text")
    rows = lines.where("text is not null").select("file", "line", F.translate("text", '"\\#\r', "'//").alias("text"), words.alias("w"))
    n = F.size("w")
    chain = F.concat(F.array_join("w", "("), F.repeat(F.lit(")"), n - 1), F.lit(""))
    # the last call has no argument
    chain = F.concat(F.array_join("w", "("), F.lit("()"), F.repeat(F.lit(")"), n - 1))
    head = F.concat(F.lit("def "), F.col("w")[0], F.lit("("), F.array_join(F.slice("w", F.lit(2), n), ", "), F.lit(") do"))
    lines = F.array(F.lit('@doc """'), F.col("text"), F.lit('"""'), head, F.lit("if true do"), chain, F.lit("end"), F.lit("end"))
    inner = F.concat(F.array(F.concat(F.lit("defmodule L"), F.col("line").cast("string"), F.lit(" do"))), lines, F.array(F.lit("end")))
    block = F.when(n == 0, F.array(F.concat(F.lit("# "), F.col("text")))).when(n % 2 == 1, inner).otherwise(lines)
    blocks = rows.select("file", "line", F.array_join(block, "\n").alias("block"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "block"))), lambda x: x["block"]), "\n")
    whole = blocks.groupBy("file").agg(body.alias("body"))
    return whole.select("file", F.concat(F.lit("defmodule D"), F.col("file"), F.lit(" do\n"), F.col("body"), F.lit("\nend\n")).alias("source"))


@query("S8 E1 E2 E3", f"""with {_SQL_LINES}
select file::varchar as file, case when n % 2 = 1 then 'L' || line else 'D' || file end as module, words[1] || '_' as name, n - 1 as arity, (spot + case when n % 2 = 1 then 4 else 3 end)::bigint as line, true as has_doc from placed where n > 0""", "source_lines")
def elixir_functions(t):
    """Functions with the innermost module around them, after modules that ended, behind texts full of code words."""
    found = elixir.functions(elixir_files(t))
    return found.select("file", "module", "name", "arity", "line", F.col("doc").isNotNull().alias("has_doc"))


@query("E5 S8", f"""with {_SQL_LINES},
c as (select file, line, n, unnest(words) as word, generate_subscripts(words, 1) as k from placed where n > 0)
select file::varchar as file, case when n % 2 = 1 then 'L' || line else 'D' || file end as caller, word || '_' as function, case when k = n then 0 else 1 end::bigint as arity, count(*) as calls from c group by all""", "source_lines")
def elixir_calls(t):
    """Calls inside calls, to any depth."""
    return elixir.call_counts(elixir_files(t))


@query("E1", f"""with {_SQL_LINES}
select file::varchar as file, 'D' || file as module, null as outer_module, 1::bigint as line, (max(spot + case when n = 0 then 1 when n % 2 = 1 then 10 else 8 end))::bigint as end_line from placed group by file
union all select file::varchar, 'L' || line, 'D' || file, spot::bigint, (spot + 9)::bigint from placed where n % 2 = 1""", "source_lines")
def elixir_modules(t):
    """Modules with the lines that they begin and end on, and the module around them."""
    return elixir.modules(elixir_files(t)).select("file", "module", F.col("outer").alias("outer_module"), "line", "end_line")
