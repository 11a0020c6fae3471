"""viewloom.streaming"""
