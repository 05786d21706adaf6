"""PySpark analytics for co-occurrence networks and labelled-group contrasts."""
