"""Charges of a job: quality-of-service factors and machine rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Factors by name, queues with a name of their own, cores and GPUs of a node.
FACTORS = {"premium": 1.5, "regular": 1.0, "economy": 0.7, "uncharged": 0.0, "special": 1.0}
QUEUE_QOS = {"jhublogin": "uncharged"}
CORES_A_NODE, GPUS_A_NODE = 128, 4
BYTES_A_GB, SECONDS_AN_HOUR = 1024**3, 3600


def qos_name(queue: Column, priority: Column) -> Column:
    """The queue's rule first, then the priority; whatever is unknown is regular."""
    out = F.when(F.lit(False), F.lit("regular"))
    for name, qos in QUEUE_QOS.items():
        out = out.when(queue == name, F.lit(qos))
    for qos in FACTORS:
        out = out.when(F.lower(priority) == qos, F.lit(qos))
    return out.otherwise(F.lit("regular"))


def qos_factor(qos: Column) -> Column:
    out = F.when(F.lit(False), F.lit(1.0))
    for name, factor in FACTORS.items():
        out = out.when(qos == name, F.lit(factor))
    return out.otherwise(F.lit(1.0))


def _zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def hours(machine: str) -> dict[str, Column]:
    """cpu_hours, gpu_hours and memory_hours of a machine's jobs."""
    elapsed, queue = _zero("elapsed"), F.coalesce(F.col("queue"), F.lit(""))
    memory = elapsed * _zero("memory") / (SECONDS_AN_HOUR * BYTES_A_GB)
    if machine == "casper":
        cpus, gpus = _zero("numcpus"), _zero("numgpus")
    elif machine == "derecho":
        own = queue.contains("dev")
        cpus = F.when(own, _zero("numcpus")).otherwise(_zero("numnodes") * CORES_A_NODE)
        whole = F.when(own, _zero("numgpus")).otherwise(_zero("numnodes") * GPUS_A_NODE)
        gpus = F.when(queue.contains("gpu"), whole).otherwise(F.lit(0))
    else:
        raise ValueError(f"no charging rules for machine {machine!r}")
    return {"cpu_hours": elapsed * cpus / SECONDS_AN_HOUR, "gpu_hours": elapsed * gpus / SECONDS_AN_HOUR, "memory_hours": memory}


def charged(jobs: DataFrame, machine: str) -> DataFrame:
    """jobs with their hours, quality of service, its factor, and charge_version 1."""
    told = hours(machine)
    qos = qos_name(F.col("queue"), F.col("priority"))
    return jobs.withColumns({**told, "qos": qos, "qos_factor": qos_factor(qos), "charge_version": F.lit(1)})


def with_charge(hours_column: str, factor: str = "qos_factor") -> Column:
    """Hours times factor; a missing factor is 1, missing hours stay missing."""
    return F.col(hours_column) * F.coalesce(F.col(factor), F.lit(1.0))
