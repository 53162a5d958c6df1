"""scorebook.plans"""
