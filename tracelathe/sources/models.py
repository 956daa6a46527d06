"""Model sink: the fitted projection, vocabulary and forests."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from tracelathe.operators.embed import PcaFit
from tracelathe.operators.forest import forest_nodes


def save_models(path: str, fit: PcaFit | None, vocabulary: DataFrame, forests: dict[str, tuple[DataFrame, list[str]]],
                ) -> None:
    """Write all fitted parts under ``path``: ML stages as a pipeline, tables as parquet."""
    if fit is not None:
        PipelineModel([fit.scaler, fit.pca]).write().overwrite().save(f"{path}/projection")
    vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    for name, (forest, keys) in forests.items():
        forest.write.mode("overwrite").parquet(f"{path}/forest/{name}/trees")
        forest_nodes(forest, keys).write.mode("overwrite").parquet(f"{path}/forest/{name}/nodes")


def load_projection(path: str) -> PcaFit:
    scaler, pca = PipelineModel.load(f"{path}/projection").stages
    return PcaFit(scaler, pca)


def load_forest(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/forest/{name}/trees")
