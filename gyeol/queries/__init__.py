"""Registered queries: each takes (spark, folder) and reads whole tables."""
