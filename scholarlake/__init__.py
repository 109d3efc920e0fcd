"""Bibliometrics on Spark: operators over author and publication documents."""
