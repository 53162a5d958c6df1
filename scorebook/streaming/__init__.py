"""scorebook.streaming"""
