"""scorebook.operators"""
