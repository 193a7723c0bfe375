"""Stored snapshots of pods and deployments, flattened."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

CONDITION = "struct<type:string,status:string,reason:string,message:string>"
POD_LIST = (
    "items array<struct<metadata:struct<name:string>,status:struct<phase:string,"
    f"conditions:array<{CONDITION}>,containerStatuses:array<struct<restartCount:bigint>>>>>"
)
DEPLOYMENT = (
    "metadata struct<name:string,namespace:string,generation:bigint>,"
    "spec struct<replicas:bigint,template:struct<spec:struct<containers:array<struct<image:string>>>>>,"
    f"status struct<readyReplicas:bigint,availableReplicas:bigint,updatedReplicas:bigint,conditions:array<{CONDITION}>>"
)


def pods_flat(snapshots: DataFrame, body: str = "body") -> DataFrame:
    """One row per pod. The last Ready condition and the last container's restarts count."""
    pods = snapshots.withColumn("_p", F.from_json(body, POD_LIST)).select(
        *[c for c in snapshots.columns if c != body], F.explode("_p.items").alias("p")
    )
    ready = F.filter(F.col("p.status.conditions"), lambda c: c["type"] == "Ready")
    restarts = F.try_element_at(F.col("p.status.containerStatuses"), F.lit(-1))["restartCount"]
    return pods.select(
        *[c for c in pods.columns if c != "p"],
        F.col("p.metadata.name").alias("name"),
        F.col("p.status.phase").alias("phase"),
        F.coalesce(F.try_element_at(ready, F.lit(-1))["status"] == "True", F.lit(False)).alias("ready"),
        F.coalesce(restarts, F.lit(0)).alias("restart_count"),
    )


def deployments_flat(snapshots: DataFrame, body: str = "body") -> DataFrame:
    """One row per deployment; absent numbers read 0, an absent image reads ''."""
    d = snapshots.withColumn("_d", F.from_json(body, DEPLOYMENT))
    number = lambda path: F.coalesce(F.col(path), F.lit(0))
    image = F.try_element_at(F.col("_d.spec.template.spec.containers"), F.lit(1))["image"]
    return d.select(
        *[c for c in snapshots.columns if c != body],
        F.col("_d.metadata.name").alias("name"),
        F.col("_d.metadata.namespace").alias("namespace"),
        number("_d.status.readyReplicas").alias("ready_replicas"),
        number("_d.spec.replicas").alias("desired_replicas"),
        number("_d.status.availableReplicas").alias("available_replicas"),
        number("_d.status.updatedReplicas").alias("updated_replicas"),
        number("_d.metadata.generation").alias("revision"),
        F.coalesce(image, F.lit("")).alias("image"),
        F.coalesce(F.col("_d.status.conditions"), F.array().cast(f"array<{CONDITION}>")).alias("conditions"),
    )


def health_class(deployments: DataFrame, database_ok: str = "database_ok") -> DataFrame:
    """HEALTHY or, when the database check failed, DEGRADED; UNHEALTHY while replicas are missing."""
    up = (F.col("ready_replicas") >= F.col("desired_replicas")) & (F.col("desired_replicas") > 0)
    health = F.when(up & F.col(database_ok), "HEALTHY").when(up, "DEGRADED").otherwise("UNHEALTHY")
    return deployments.withColumn("health", health)
