"""Named queries over the test tables, and the DuckDB SQL that must give the same rows."""

from __future__ import annotations


def queries():
    from . import data_problems, documents_plan, markets_plan

    return {**data_problems.QUERIES, **documents_plan.QUERIES, **markets_plan.QUERIES}


def oracle_sql():
    from . import data_problems, documents_plan, markets_plan

    return {**data_problems.SQL, **documents_plan.SQL, **markets_plan.SQL}
