"""GeoJSON feature documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def feature_schema(properties: T.StructType, geometry: T.DataType | None = None) -> T.StructType:
    geom = geometry or T.StructType([T.StructField("type", T.StringType())])
    return T.StructType(
        [
            T.StructField("type", T.StringType()),
            T.StructField("id", T.StringType()),
            T.StructField("geometry", geom),
            T.StructField("properties", properties),
        ]
    )


def explode_features(df: DataFrame, body_col: str, schema: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """One row per feature from a FeatureCollection, a bare list of features
    or a single Feature; anything else yields no rows (S17).

    Adds ``pos`` (0-based position in the document) and ``feature``.
    """
    body = F.col(body_col)
    kind = F.get_json_object(body, "$.type")
    coll = T.StructType([T.StructField("features", T.ArrayType(schema))])
    feats = (
        F.when(kind == "FeatureCollection", F.from_json(body, coll).features)
        .when(kind == "Feature", F.array(F.from_json(body, schema)))
        .when(F.ltrim(body).startswith("["), F.from_json(body, T.ArrayType(schema)))
    )
    return df.select(*keep, F.posexplode(feats).alias("pos", "feature"))


def flatten_feature(df: DataFrame, feature_col: str, drop: Sequence[str] = ()) -> DataFrame:
    """``properties.*`` expanded next to the feature id and point coordinates
    (1-based ``element_at``: lon first, lat second); listed duplicates dropped
    (P3, P4)."""
    f = F.col(feature_col)
    coords = f.geometry.coordinates
    out = df.select(
        "*",
        f.id.alias("feature_id"),
        f.geometry.type.alias("geom_type"),
        F.element_at(coords, 1).alias("lon"),
        F.element_at(coords, 2).alias("lat"),
        f"{feature_col}.properties.*",
    ).drop(feature_col)
    return out.drop(*drop)


def json_field(text: Column | str, *paths: str) -> Column:
    """First non-NULL of several JSON paths (key-casing fallbacks) (P5)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(*[F.get_json_object(t, p) for p in paths])
