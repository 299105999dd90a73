"""Scoreweave: profile many tables, score many learners, predict the scores.

Everything is expressed as Spark DataFrame jobs; see README.md for the map.
"""
