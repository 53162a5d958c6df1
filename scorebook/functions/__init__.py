"""scorebook.functions"""
