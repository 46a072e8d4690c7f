"""Item-bank and response analytics as DataFrame-to-DataFrame operators on Spark."""
