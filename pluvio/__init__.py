"""Pluvio: weather-radar nowcasting and verification as Spark DataFrame operators."""
