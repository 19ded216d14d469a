"""frameloom.streaming"""
