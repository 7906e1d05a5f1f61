"""What kind of file a target is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_dockerfile(path: Column) -> Column:
    name = F.lower(path)
    return name.endswith("dockerfile") | name.contains("dockerfile.")


def is_manifest(path: Column, content: Column) -> Column:
    """Whether the target is a Kubernetes manifest; the path is tested first."""
    name = F.lower(path)
    return (
        (name.endswith(".yaml") | name.endswith(".yml"))
        & content.contains("apiVersion:")
        & (content.contains("kind:") | content.contains("metadata:"))
    )


def rule_family(path: Column, content: Column) -> Column:
    """Family of the line rules a target gets; a Dockerfile name wins."""
    return F.when(is_dockerfile(path), "docker").when(is_manifest(path, content), "k8s")
