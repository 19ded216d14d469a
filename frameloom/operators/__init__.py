"""frameloom.operators"""
