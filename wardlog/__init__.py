"""wardlog: sensor-log threat analytics as Spark DataFrame operators."""
