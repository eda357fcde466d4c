"""Schemas of the relations."""

from pyspark.sql import types as T

_TEXT = T.StringType()


def _columns(kinds: str) -> T.StructType:
    return T.StructType([T.StructField(*pair) for pair in [(x.split(":")[0], {"s": _TEXT, "l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "t": T.TimestampType()}[x.split(":")[1]]) for x in kinds.split()]])


#: The 26 columns of the metadata file, in its order.
SURVEY_FILE = _columns(
    "$id:l $name:s $section_id:i $section_name:s $created_by_id:i $created_by_username:s $created_by_name:s $created_datetime:t "
    "$modified_by_id:i $modified_by_username:s $modified_by_name:s $modified_datetime:t $type_name:s $type_id:i $width:i $height:i "
    "$streaming_resolutions:s $archive_state:s $url:s FileType:s altitude:d date:t latitude:d longitude:d make:s model:s"
)
SITE_COLORS = _columns("location:s L:i A:i B:i")
RESULT = _columns("image_name:s image_id:l latitude:d longitude:d coverage_percentage:d")
RESULTS_DOCUMENT = T.StructType([T.StructField("command", _TEXT), T.StructField("run_args", T.MapType(_TEXT, _TEXT)), T.StructField("results", T.ArrayType(RESULT))])
RASTER = T.StructType([*_columns("image:s height:i width:i n_channels:i"), T.StructField("data", T.BinaryType())])
