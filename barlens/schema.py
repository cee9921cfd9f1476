"""Fixed schemas of the bar table, the raw feed and the dimensions (never inferred)."""

from pyspark.sql import types as T

PRICE = T.DecimalType(18, 4)
# Sums of prices are reported at this type in Spark and in the SQL oracle alike.
PRICE_SUM = T.DecimalType(38, 4)

BAR_COLUMNS = ["TradeDate", "Ticker", "IndexName", "OpenPrice", "HighPrice",
               "LowPrice", "ClosePrice", "Volume"]

BARS = T.StructType([
    T.StructField("TradeDate", T.DateType(), False),
    T.StructField("Ticker", T.StringType(), False),
    T.StructField("IndexName", T.StringType(), False),
    T.StructField("OpenPrice", PRICE, False),
    T.StructField("HighPrice", PRICE, False),
    T.StructField("LowPrice", PRICE, False),
    T.StructField("ClosePrice", PRICE, False),
    T.StructField("Volume", T.LongType(), False),
])

# The stored table adds a dense surrogate key and a load stamp.
STORED_BARS = T.StructType(
    [T.StructField("PriceID", T.LongType(), False)] + BARS.fields
    + [T.StructField("CreatedAt", T.TimestampNTZType(), True)])

# The vendor extract before renaming; it carries no index name.
FEED_COLUMNS = ["Date", "Ticker", "Open", "High", "Low", "Close", "Volume"]
FEED = T.StructType([
    T.StructField("Date", T.DateType(), False),
    T.StructField("Ticker", T.StringType(), False),
    T.StructField("Open", PRICE, True),
    T.StructField("High", PRICE, True),
    T.StructField("Low", PRICE, True),
    T.StructField("Close", PRICE, True),
    T.StructField("Volume", T.LongType(), True),
])

# Feed name -> table name.
FEED_RENAMES = {"Date": "TradeDate", "Open": "OpenPrice", "High": "HighPrice",
                "Low": "LowPrice", "Close": "ClosePrice"}

DIM_MARKET = T.StructType([
    T.StructField("Ticker", T.StringType(), False),
    T.StructField("IndexName", T.StringType(), False),
    T.StructField("Country", T.StringType(), True),
])
