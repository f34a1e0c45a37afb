"""Running queries from outside: rows one after another, typed bindings, and a command for query files.

    python -m palimpsest.plans.driver QUERY.sql --facts FOLDER [--limit N]
"""

from __future__ import annotations

import argparse
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, types as T

from .store import FactStore

#: What a typed binding is called, by Spark's type.
TYPES = {T.LongType: "integer", T.IntegerType: "integer", T.DoubleType: "decimal", T.DecimalType: "decimal", T.BooleanType: "boolean"}


def rows(df: DataFrame) -> Iterator[tuple[list[str], dict]]:
    """(variables, row) one by one; partitions come to the driver one at a time."""
    names = df.columns
    for r in df.toLocalIterator():
        yield names, r.asDict()


def first(df: DataFrame) -> dict | None:
    r = df.head(1)
    return r[0].asDict() if r else None


def shortened(value, prefixes: dict[str, str]):
    """A name with the prefix that stands for its beginning, if there is one: prefixes by name."""
    for name, uri in prefixes.items():
        if isinstance(value, str) and value.startswith(uri):
            return f"{name}:{value[len(uri):]}"
    return value


def bindings(df: DataFrame, most: int = -1, prefixes: dict[str, str] | None = None) -> dict:
    """Head and bindings as a query endpoint answers: {var: {type, value, datatype}}, ``most`` rows (all, if negative).  Unbound variables are left out."""
    limited = df if most < 0 else df.limit(most)
    kinds = {f.name: TYPES.get(type(f.dataType)) for f in df.schema.fields}
    out = []
    for _, row in rows(limited):
        b = {}
        for name, value in row.items():
            if value is None:
                continue
            if kinds[name]:
                b[name] = {"type": "typed-literal", "value": str(value).lower() if kinds[name] == "boolean" else str(value), "datatype": f"xsd:{kinds[name]}"}
            else:
                is_name = isinstance(value, str) and "://" in value
                b[name] = {"type": "uri" if is_name else "literal", "value": shortened(value, prefixes or {}) if is_name else str(value)}
        out.append(b)
    return {"head": {"vars": df.columns}, "results": {"bindings": out}}


def typed(binding: dict) -> dict:
    """Python values of a row's bindings."""
    make = {"xsd:integer": int, "xsd:decimal": float, "xsd:boolean": lambda v: v == "true"}
    return {name: make.get(b.get("datatype"), str)(b["value"]) for name, b in binding.items()}


def report(df: DataFrame) -> Iterator[str]:
    """Lines of a text report: each row with its variables, and how many there are."""
    n = 0
    for names, row in rows(df):
        yield f"* row[{n}]"
        yield from (f'  {v}="{row[v]}"' for v in names)
        n += 1
    yield f"{n} rows"


def run_file(store: FactStore, path: str, limit: int = -1) -> DataFrame:
    """The result of a file with SQL over the predicates' views."""
    with open(path, encoding="utf-8") as f:
        df = store.query(f.read())
    return df if limit < 0 else df.limit(limit)


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("query_file")
    p.add_argument("--facts", required=True, help="folder of a fact store")
    p.add_argument("--limit", type=int, default=-1)
    a = p.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    for line in report(run_file(FactStore(spark, a.facts), a.query_file, a.limit)):
        print(line)


if __name__ == "__main__":
    main()
