"""viewloom.sources"""
