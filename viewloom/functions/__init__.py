"""viewloom.functions"""
