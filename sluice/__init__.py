"""Collects, cleans and resolves job-posting records with Spark."""
