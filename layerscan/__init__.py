"""Explore large geospatial and tabular datasets with Spark."""

from layerscan.session import configure

__all__ = ["configure", "open_dataset"]


def open_dataset(spark, path, **options):
    """The dataset at ``path``; see :func:`layerscan.plans.dataset.open_dataset`."""
    from layerscan.plans.dataset import open_dataset as opener

    return opener(spark, path, **options)
