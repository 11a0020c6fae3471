"""viewloom.operators"""
