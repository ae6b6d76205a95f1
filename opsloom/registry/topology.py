"""Dependency-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import topology
from opsloom.registry import Views, query


def closure_sql(edges: str) -> str:
    return f"""with recursive reach as (
      select src, dst from {edges} union select r.src, e.dst from reach r join {edges} e on e.src = r.dst),
    pairs as (select distinct src, dst from reach where src <> dst)"""


SERVICE_CLOSURE = closure_sql("{service_edges}")


def _services(v: Views):
    return v.telemetry.select(F.col("service_name").alias("service")).distinct()


@query("dependencies", SERVICE_CLOSURE + " select src as service, dst as dependency from pairs")
def dependencies(v: Views):
    return topology.dependencies(v.service_edges, _services(v))


@query("blast_radius", SERVICE_CLOSURE + " select dst as service, src as impacted from pairs")
def blast_radius(v: Views):
    return topology.blast_radius(v.service_edges, _services(v))


@query(
    "closure_all",
    closure_sql("{entity_edges}") + " select dst as node, count(*) as dependents from pairs group by dst",
)
def closure_all(v: Views):
    return topology.dependent_counts(v.entity_edges)


@query(
    "topology_text",
    SERVICE_CLOSURE + """, s as (select distinct service_name as service from {telemetry}),
    need as (select src, '[' || string_agg('''' || dst || '''', ', ' order by dst) || ']' as t from pairs group by src),
    hit as (select dst, '[' || string_agg('''' || src || '''', ', ' order by src) || ']' as t from pairs group by dst)
    select service, 'Service: ' || service || ' | Dependencies: ' || coalesce(need.t, '[]')
      || ' | Impacted If Failed: ' || coalesce(hit.t, '[]') as topology
    from s left join need on need.src = s.service left join hit on hit.dst = s.service""",
)
def topology_text(v: Views):
    services = _services(v)
    return topology.topology_text(
        services, topology.dependencies(v.service_edges), topology.blast_radius(v.service_edges)
    )


@query(
    "edge_relations",
    """select e.src as service, e.dst, e.relation from {service_edges} e
    where e.src in (select service_name from {telemetry})""",
)
def edge_relations(v: Views):
    return topology.neighbours(v.service_edges, _services(v))
