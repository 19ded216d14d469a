"""frameloom.plans"""
