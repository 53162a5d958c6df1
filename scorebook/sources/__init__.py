"""scorebook.sources"""
