"""Access: grants, column masks and row filters, closed by default, applied where a table is read."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class AccessDenied(PermissionError):
    pass


@dataclass
class Catalog:
    """Rules by table; principals are users with the groups they are in."""

    groups: dict[str, set[str]] = field(default_factory=dict)
    grants: list[tuple[str, str, str, str]] = field(default_factory=list)  # (kind, privilege, object, principal)
    masks: dict[tuple[str, str], tuple[Column | str, set[str]]] = field(default_factory=dict)
    filters: dict[str, dict[str, str]] = field(default_factory=dict)
    tags: dict[tuple[str, str], dict[str, str]] = field(default_factory=dict)
    policies: list[tuple[str, str, str, set[str]]] = field(default_factory=list)

    views: dict[str, tuple[str, object]] = field(default_factory=dict)

    def view(self, name: str, table: str, plan) -> None:
        """A view: a plan over what its reader sees of a table. It can't have rules of its own."""
        self.views[name] = table, plan

    def who(self, user: str) -> set[str]:
        return {user} | {g for g, members in self.groups.items() if user in members}

    def grant(self, privilege: str, obj: str, principal: str) -> None:
        self.grants.append(("GRANT", privilege, obj, principal))

    def deny(self, privilege: str, obj: str, principal: str) -> None:
        self.grants.append(("DENY", privilege, obj, principal))

    def revoke(self, privilege: str, obj: str, principal: str) -> None:
        self.grants = [g for g in self.grants if g[1:] != (privilege, obj, principal)]

    def allowed(self, user: str, privilege: str, obj: str) -> bool:
        """A table inherits from its schema ("a" from "a.b"); DENY beats GRANT; without a rule: no."""
        parts = obj.split(".")
        scope = {".".join(parts[: k + 1]) for k in range(len(parts))}
        kinds = {kind for kind, p, o, principal in self.grants if p in (privilege, "ALL") and o in scope and principal in self.who(user)}
        return "GRANT" in kinds and "DENY" not in kinds

    def mask(self, table: str, column: str, masked: Column | str, clear_for: set[str]) -> None:
        """Others than clear_for see `masked` (an expression, or a constant) instead of the column."""
        self._no_view(table)
        self.masks[table, column] = masked, clear_for

    def row_filter(self, table: str, rules: dict[str, str]) -> None:
        """SQL conditions by principal; a user sees rows of any rule that is theirs, else none."""
        self._no_view(table)
        self.filters[table] = rules

    def _no_view(self, table: str) -> None:
        if table in self.views:
            raise ValueError(f"{table} is a view: masks and filters belong to its table")

    def policies_on(self, schema: str) -> list[tuple[str, str, str]]:
        """(object, kind, rule) of all masks and filters on tables of a schema."""
        inside = lambda t: t == schema or t.startswith(f"{schema}.")
        masks = [(f"{t}.{c}", "mask", str(m)) for (t, c), (m, _) in self.masks.items() if inside(t)]
        return sorted(masks + [(t, "filter", f"{p}: {sql}") for t, rules in self.filters.items() if inside(t) for p, sql in rules.items()])

    def tag(self, table: str, column: str, **tags: str) -> None:
        self.tags.setdefault((table, column), {}).update(tags)

    def policy(self, tag: str, value: str, masked: str, clear_for: set[str]) -> None:
        """A mask for every column that carries the tag, in any table."""
        self.policies.append((tag, value, masked, clear_for))

    def read_as(self, user: str, table: str, df: DataFrame) -> DataFrame:
        """What a user sees: a filter and a projection, which Spark pushes into the scan."""
        if not self.allowed(user, "SELECT", table):
            raise AccessDenied(f"{user} may not read {table}")
        if table in self.views:
            base, plan = self.views[table]
            return plan(self._shown(user, base, df))
        return self._shown(user, table, df)

    def _shown(self, user: str, table: str, df: DataFrame) -> DataFrame:
        mine = self.who(user)
        if table in self.filters:
            rule = F.lit(False)
            for principal, sql in self.filters[table].items():
                if principal in mine:
                    rule = rule | F.coalesce(F.expr(sql), F.lit(False))
            df = df.filter(rule)
        cols = []
        for c in df.columns:
            masked = self.masks.get((table, c))
            for tag, value, expr, clear in self.policies:
                if masked is None and self.tags.get((table, c), {}).get(tag) == value:
                    masked = (expr, clear)
            if masked is None or masked[1] & mine:
                cols.append(F.col(c))
            else:
                expr = masked[0] if isinstance(masked[0], Column) else F.expr(masked[0])
                cols.append(expr.cast(df.schema[c].dataType).alias(c))
        return df.select(*cols)

    def audit(self, spark: SparkSession) -> DataFrame:
        """A snapshot of all grants."""
        return spark.createDataFrame(self.grants, "kind string, privilege string, object string, principal string")

    def tagged(self, spark: SparkSession) -> DataFrame:
        rows = [(t, c, k, v) for (t, c), tags in self.tags.items() for k, v in tags.items()]
        return spark.createDataFrame(rows, "table string, column string, tag string, value string")


def table_columns(spark: SparkSession, database: str = "default") -> DataFrame:
    """(table, column, type, comment) of a schema's tables and views."""
    rows = [(t.name, c.name, c.dataType, c.description) for t in spark.catalog.listTables(database) for c in spark.catalog.listColumns(f"{database}.{t.name}" if not t.isTemporary else t.name)]
    return spark.createDataFrame(rows, "table string, column string, type string, comment string")
