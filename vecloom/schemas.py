"""Schemas of the tables that are kept at rest."""

from pyspark.sql import types as T

STORE = T.StructType(
    [
        T.StructField("track_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("artist", T.StringType()),
        T.StructField("album", T.StringType()),
        T.StructField("genre", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("embedding_dim", T.IntegerType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

RESOLUTION_CACHE = T.StructType(
    [
        T.StructField("cache_key", T.StringType()),
        T.StructField(
            "entries",
            T.ArrayType(
                T.StructType(
                    [T.StructField("url", T.StringType()), T.StructField("title", T.StringType())]
                )
            ),
        ),
    ]
)

_ARTIST_CREDIT = T.ArrayType(
    T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField(
                "artist",
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("sort-name", T.StringType()),
                        T.StructField("id", T.StringType()),
                    ]
                ),
            ),
        ]
    )
)

ARTIST_CREDIT = _ARTIST_CREDIT

# A release as a metadata service returns it, cut to the fields that become tags.
RELEASE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("barcode", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("artist-credit", _ARTIST_CREDIT),
        T.StructField(
            "release-group",
            T.StructType(
                [
                    T.StructField("id", T.StringType()),
                    T.StructField("first-release-date", T.StringType()),
                    T.StructField("primary-type", T.StringType()),
                    T.StructField("secondary-types", T.ArrayType(T.StringType())),
                ]
            ),
        ),
        T.StructField(
            "label-info",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("catalog-number", T.StringType()),
                        T.StructField("label", T.StructType([T.StructField("name", T.StringType())])),
                    ]
                )
            ),
        ),
        T.StructField(
            "media",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("position", T.IntegerType()),
                        T.StructField("track-count", T.IntegerType()),
                        T.StructField(
                            "tracks",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("number", T.StringType()),
                                        T.StructField("position", T.IntegerType()),
                                        T.StructField(
                                            "recording",
                                            T.StructType([T.StructField("id", T.StringType())]),
                                        ),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)
